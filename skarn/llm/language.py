"""Language of a text by its function words."""

from __future__ import annotations

import re

from skarn.llm.chars import Apart

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to is in for that with it on as are was be by this from or which you must may how when if at but what so not an has can will before after then an into only its does do should a",
    "de": "der die das und ist den von zu mit sich des auf für nicht ein eine als auch es werden aus dem wird wenn oder sie wie bei nach zum zur im bitte keine wurde kann muss um vor danach bis dass dann einer einen seit während ohne haben sind ihr noch",
    "fr": "le les et des une est dans pour que qui sur pas avec au du par ce il ne sont plus ou aux vous avant après sans quand cette deux afin lorsque puis ensuite possible peut doit veuillez été depuis pendant aucune la un de",
    "es": "el los las y una es para con por se del al su lo como más sin cuando antes tras debe después hasta fue dos no ninguna puede esta llame avise que entre desde si en la un de",
    "it": "il lo gli della di che è per non con una del alla dal nel sono prima dopo se fino dei delle essere più come anche questo può deve poi sul al e ed ora la un",
    "pt": "o os as uma não com para do da dos das em no na ao é por se até depois antes que foi são pela pelo mais como deve pode isso esses um e esta sem quando",
    "nl": "de het een en van is op te dat niet met voor zijn aan om ook als er maar naar bij uit wordt worden dan nog door kan moet voordat nadat deze die u wel geen tot in",
    "sv": "och att det som en på är av för med till den har inte om ett men var sig från vid eller när efter innan kan ska måste",
    "da": "og at det som en på er af for med til den har ikke om et men var sig fra ved eller når efter før kan skal må i de",
    "pl": "i w na z do się nie że jest to o jak przez po przed dla od oraz być może należy który ten te gdy jeśli",
    "fi": "ja on ei se että oli hän ovat mutta kun niin tai myös ennen jälkeen voi pitää jos sekä",
    "tr": "ve bir bu için ile da de olarak sonra önce gibi daha çok ne ama değil olan kadar her",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def _weights() -> dict[str, tuple[float, ...]]:
    """Weight of each word by language: 1 for a word of one language, shared out among several."""
    sets = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
    out = {}
    for word in set().union(*sets.values()):
        inside = [word in sets[lang] for lang in LANGUAGES]
        out[word] = tuple(1.0 / sum(inside) ** 0.7 if x else 0.0 for x in inside)
    return out


WEIGHTS = _weights()
_SHARES = {word: tuple((k, x) for k, x in enumerate(w) if x) for word, w in WEIGHTS.items()}
NONE = (0.0,) * len(LANGUAGES)
CODE = re.compile(r"```.*?```|`[^`\n]*`|(?<!\S)[^\s/{}=]*[/{}=]\S*|\"[^\"\n]{0,400}\"", re.S)
_LETTERS = Apart(lambda c: c.isalnum() and not c.isdecimal())


def letters(text: str) -> str:
    """The lower-case letters outside code, paths and quotations, all else as spaces."""
    return _LETTERS(CODE.sub(" ", text).lower())


def language_words(text: str) -> list[str]:
    """Lower-case words outside code, paths and quotations."""
    return letters(text).split()


def language_scores(tokens: list[str]) -> list[float]:
    """Share of function words by language, in the order of ``LANGUAGES``."""
    total = [0.0] * len(LANGUAGES)
    for shares in filter(None, map(_SHARES.get, tokens)):
        for k, x in shares:
            total[k] += x
    n = max(1, len(tokens))
    return [x / n for x in total]

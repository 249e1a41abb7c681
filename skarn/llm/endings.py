"""How a text ends: complete, cut, or in doubt. Shared by the operators for cut texts and for broken pairs."""

from __future__ import annotations

import re
from collections import Counter

from skarn.llm.chars import plain, words

COMPLETE, CUT, DOUBT = 0, 1, 2

#: Marks that say the rest was left out.
MARK = re.compile(
    r"(?:\.{3,}|…|[\[(<{]\s*(?:\.{2,}|…|(?:text |output |answer )?(?:truncated|cut(?: off)?|continued|abridged|shortened|snip(?:ped)?|omitted|more))[^\])>}]*[\])>}])$",
    re.I,
)
CALL = re.compile(r"(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) +(/\S*)")
_LAST_CALL = re.compile(r"^\s*(?:\d+[.)] +)?(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)(?: +(\S*))?$")
_TERMINAL = re.compile(r"[.!?。！？][\"'»”’)\]`*_]*$")
_CLOSER = re.compile(r"([\"'»”’)\]`}])$")
_LIST_NUMBER = re.compile(r"^\s*(?:\d+[.)]?|[-*•])$")
_OPENING = re.compile(r"^\s*(?:Step \d+.*|Body:|Sample request body:|Query parameters:?|Module:.*|Postman Example:.*|Workflow:.*|Note:)$")
_PARAMETERS = re.compile(r"^\s*Query parameters: *(.*)$")
_NUMBER_END = re.compile(r"(\w+) \d+\.$")
_ONE_WORD = re.compile(r"^\S+$")

_PATHS = re.compile(r"/[A-Za-z][^\s`\"',;)]*(?=([\s`\"',;).]))")
_PARAM_VALUES = re.compile(r"=([A-Za-z0-9_.]+)(?=[,\n])")
_NUMBERS = re.compile(r" \d+\.(?=([\d\s]))")
_UNIT = {"`": re.compile(r"(\S+) `[^`\n]*`$"), ")": re.compile(r"(\(\w+)[^()\n]*\)$"), '"': re.compile(r'(\S+) "[^"\n]*"$')}
_UNITS = re.compile(r" (?:`[^`\n]*`|\"[^\"\n]*\")(?=\W)|(\(\w+)[^()\n]*\)(?=\W)")
#: Marks and closing numbers stand within this many characters of the end.
_TAIL = 120
#: What stands for no answer at all.
STAND_IN = re.compile(
    r"[\[(<{\"'*]*(?:n\s?/\s?a|none|null|nil|nan|empty|blank|no (?:response|answer|output|content|reply)(?: (?:given|provided|available|generated))?|not available|tbd|undefined)?[\])>}\"'*.]*[-–—_.…\s]*",
    re.I,
)


def stands_for_nothing(text: str | None) -> bool:
    """Null, blank, invisible, or nothing but a stand-in for no answer."""
    return not text or STAND_IN.fullmatch(plain(text).strip()) is not None


def _shape(word: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"[A-Z]+(?=\d)", "A", word))[-24:]


def _segments(path: str) -> list[str]:
    return ["{}" if s.startswith("{") and s.endswith("}") else s for s in path.strip("/").split("/")]


def _unbalanced(text: str) -> bool:
    if text.count("```") % 2:
        return True
    inline = text.replace("```", "")
    if inline.count("`") % 2 or text.count('"') % 2 or text.count("“") > text.count("”"):
        return True
    return text.count("{") > text.count("}") or text.count("[") > text.count("]") or text.rfind("(") > text.rfind(")")


def ending(text: str | None, path: str | None = None) -> tuple[int, str]:
    """(COMPLETE, CUT or DOUBT, key). The key of a doubt names the closing words, for :func:`terminality`."""
    if stands_for_nothing(text):
        return COMPLETE, ""
    t = plain(text).rstrip()
    if MARK.search(t[-_TAIL:]):
        return CUT, "mark"
    if _ONE_WORD.match(t) and "/" not in t:
        return COMPLETE, ""
    if _unbalanced(t):
        return CUT, "open"
    cut_at = t.rfind("\n") + 1
    last, first_line = t[cut_at:], cut_at == 0
    if not first_line and _LIST_NUMBER.match(last):
        return CUT, "list"
    if call := _LAST_CALL.match(last):
        target = (call.group(2) or "").rstrip(".")
        if path and target == path:
            return COMPLETE, ""
        if path and path.startswith(target):
            return CUT, "path"
        if len(target) < 2 or target.endswith("/"):
            return CUT, "path"
        segments = _segments(target)
        return DOUBT, "s:" + "/".join(segments[-3:])
    if parameters := _PARAMETERS.match(last):
        value = parameters.group(1).rsplit(",", 1)[-1].strip()
        if re.fullmatch(r"\w+=[A-Za-z0-9_.]+", value):
            return DOUBT, "v:" + value.partition("=")[2]
        return CUT, "parameter"
    if not first_line and _OPENING.match(last):
        return CUT, "opening"
    if _TERMINAL.search(t):
        if t[-2:-1].isdecimal() and (number := _NUMBER_END.search(t[-_TAIL:])):
            return DOUBT, "n:" + number.group(1)
        return COMPLETE, ""
    if last.startswith(("{", "}")) or t.endswith("```") or t.endswith("}\n```"):
        return COMPLETE, ""
    if closer := _CLOSER.search(t):
        unit = _UNIT.get(closer.group(1))
        if unit and (before := unit.search(last)):
            return DOUBT, f"u:{_shape(before.group(1))} {closer.group(1)}"
        return COMPLETE, ""
    return CUT, "word"


def closing_counts(text: str, counts: Counter) -> None:
    """Add to ``counts``: for each key of a doubt, how often it stands (key, 0) and how often it closes (key, 1)."""
    for match in _PATHS.finditer(text):
        segments = _segments(match.group().rstrip("."))
        for k in range(2, len(segments) + 1):
            key = "s:" + "/".join(segments[max(0, k - 3) : k])
            counts[key, 0] += 1
            if k == len(segments):
                counts[key, 1] += 1
    for value in _PARAM_VALUES.findall(text):
        counts["v:" + value, 0] += 1
        counts["v:" + value, 1] += 1
    for match in _NUMBERS.finditer(text):
        before = _word_before(text, match.start())
        if before.isalnum():
            counts["n:" + before, 0] += 1
            if not match.group(1).isdigit():
                counts["n:" + before, 1] += 1
    for match in _UNITS.finditer(text):
        if paren := match.group(1):
            counts[f"u:{_shape(paren)} )", 0] += 1
        elif before := _word_before(text, match.start()):
            counts[f"u:{_shape(before)} {text[match.start() + 1]}", 0] += 1


def _word_before(text: str, at: int) -> str:
    """The word that ends at ``at``."""
    return text[max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1 : at]


def closes(text: str, key: str, counts: Counter) -> None:
    """A text that ends with the closing words ``key`` counts as one more that closes with them."""
    if key.startswith("u:"):
        counts[key, 0] += 1
        counts[key, 1] += 1


def is_copy(text: str, question: str | None, least: float = 0.72) -> bool:
    """The text is only the question, once or several times over: the same words but for slips, synonyms and a label,
    whatever the order."""
    if not question:
        return False
    x, y = Counter(words(text)), Counter(words(question))
    n, asked = sum(x.values()), sum(y.values())
    times = max(1, round(n / max(1, asked)))
    return sum([min(c, times * y[w]) for w, c in x.items() if w in y]) >= least * max(1, n, times * asked)

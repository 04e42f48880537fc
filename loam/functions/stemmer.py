"""English stemmer, after the published Porter2 rules."""

from __future__ import annotations

import re

_V = "aeiouy"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(f"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def _step1(w: str, r1: int) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if not re.search(f"[{_V}]", base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
                return base[:-1]
            return base + "e" if r1 >= len(base) and _short_end(base) else base
    return w


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub("^y", "Y", w)
    w = re.sub(f"([{_V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    w = _step1(w, r1)
    if w in _KEPT:
        return w
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()

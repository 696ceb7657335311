"""English word stemmers: Porter (1980, with the usual later amendments) and Porter2.

Both are written from the published descriptions of the algorithms. They work on one word
and are called once per distinct word of an Arrow batch.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------- Porter

# Irregular words and their stems.
PORTER_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix and replacement of steps 2, 3 and 4 (the published tables).
PORTER_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
PORTER_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
PORTER_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """Letters as c(onsonant) or v(owel); y is a vowel after a consonant."""
    out = []
    for ch in word:
        if ch in "aeiou" or (ch == "y" and out and out[-1] == "c"):
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short_end(stem: str) -> bool:
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules, least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            kept = stem + "l" if suffix == "logi" else stem
            return stem + new if _measure(kept) >= least else word
    return word


def porter(word: str) -> str:
    w = word.lower()
    if w in PORTER_IRREGULAR:
        return PORTER_IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive forms
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        stem = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in _shape(w[: -len(x)])), None)
        if stem is not None:
            if stem.endswith(("at", "bl", "iz")):
                w = stem + "e"
            elif _double(stem):
                w = stem if stem[-1] in "lsz" else stem[:-1]
            else:
                w = stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    # suffix tables
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    w = _swap(w, PORTER_STEP2, 1)
    w = _swap(w, PORTER_STEP3, 1)
    for suffix in PORTER_STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # tidy up
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# ---------------------------------------------------------------- Porter2 (Snowball English)

# Exceptional words, words left alone after step 1a, and region prefixes.
PORTER2_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning",
    "cannings": "canning", "herring": "herring", "herrings": "herring", "earring": "earring", "earrings": "earring",
    "proceed": "proceed", "proceeds": "proceed", "proceeded": "proceed", "proceeding": "proceed",
    "exceed": "exceed", "exceeds": "exceed", "exceeded": "exceed", "exceeding": "exceed",
    "succeed": "succeed", "succeeds": "succeed", "succeeded": "succeed", "succeeding": "succeed",
}
PORTER2_PREFIXES = ("gener", "commun", "arsen")
PORTER2_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
PORTER2_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
PORTER2_STEP4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
]

_V = "aeiouy"


def _region(w: str, start: int) -> int:
    m = re.search(f"[{_V}][^{_V}]", w[start:])
    return start + m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def porter2(word: str) -> str:
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return word.lower()
    if w in PORTER2_SPECIAL:
        return PORTER2_SPECIAL[w]
    w = w[1:] if w.startswith("'") else w
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    prefix = next((p for p in PORTER2_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    # past and progressive forms
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(suffix):
            continue
        at = len(w) - len(suffix)
        if suffix.startswith("eed"):
            w = w[:at] + "ee" if at >= r1 else w
        elif re.search(f"[{_V}]", w[:at]):
            w = w[:at]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # suffix tables, longest first
    for suffix, new in PORTER2_STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            fits = {"ogi": w[:at].endswith("l"), "li": w[:at].endswith(tuple("cdeghkmnrt"))}.get(suffix, True)
            w = w[:at] + new if at >= r1 and fits else w
            break
    for suffix, new in PORTER2_STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            w = w[:at] + new if at >= r1 and (suffix != "ative" or at >= r2) else w
            break
    for suffix in PORTER2_STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            w = w[:at] if at >= r2 and (suffix != "ion" or w[:at].endswith(("s", "t"))) else w
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")

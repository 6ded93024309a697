"""User patterns in RE2 syntax, spelled for ``java.util.regex``.

Only what decides whether a line matches is carried over; group names and greediness are not needed for
that and are dropped.  Constructs RE2 does not have (lookaround, backreferences, possessive repeats) raise
``ValueError``, so a bad pattern fails before any job runs.

Java tries alternatives one after the other, which can take time exponential in the line.  ``backtracks`` tells patterns
for which that may be; these are matched by RE2 itself, in Arrow batches, in time linear in the line.  Strings that every
match holds (``required_strings``) are looked for first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

# ASCII classes by name.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
# Class escapes as set contents, and their complements as ranges (both usable in any class).
_SETS = {
    "d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r ",
    "D": r"\x00-/:-\x{10FFFF}",
    "W": r"\x00-/:-@\[-\^`{-\x{10FFFF}",
    "S": r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}",
}
_SIMPLE = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:P?<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)]))")
# Unicode categories and scripts by name.
_CATEGORY = re.compile(r"C[cfos]?|L[lmotu]?|M[cen]?|N[dlo]?|P[cdefios]?|S[ckmo]?|Z[lps]?|Any")
_SCRIPTS = frozenset("""
    Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi
    Braille Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Common Coptic Cuneiform
    Cypriot Cyrillic Deseret Devanagari Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Georgian
    Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana
    Imperial_Aramaic Inherited Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi
    Khitan_Small_Script Khmer Khojki Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar
    Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive
    Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nandinagari New_Tai_Lue Newa Nko Nushu
    Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian
    Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi
    Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting Sinhala Sogdian Sora_Sompeng Soyombo Sundanese
    Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut Telugu Thaana Thai Tibetan Tifinagh
    Tirhuta Ugaritic Vai Wancho Warang_Citi Yezidi Yi Zanabazar_Square
""".split())
_MOST_REPEATS = 1000
# Open repeats outside of each other: with two the time is quadratic at worst where the second fails.
_OPEN_REPEATS = 2
_SHORTEST = 2


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def done(self) -> bool:
        return self.at >= len(self.text)

    def rest(self, prefix: str) -> bool:
        return self.text.startswith(prefix, self.at)

    def take(self, n: int = 1) -> str:
        piece = self.text[self.at:self.at + n]
        self.at += n
        return piece

    def match(self, regex: re.Pattern):
        found = regex.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found


def _bad(pattern: str, why: str) -> ValueError:
    return ValueError(f"invalid pattern {pattern!r}: {why}")


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 or char in " _\n\t" else "\\" + char


def _property(r: _Reader, negate: bool) -> str:
    if r.rest("{"):
        end = r.text.find("}", r.at)
        if end < 0:
            raise _bad(r.text, "unclosed property")
        name = r.take(end + 1 - r.at)[1:-1]
    else:
        name = r.take()
    if name.startswith("^"):
        name, negate = name[1:], not negate
    if not name:
        raise _bad(r.text, "property without a name")
    if not _CATEGORY.fullmatch(name) and name not in _SCRIPTS:
        raise _bad(r.text, f"unknown property {name}")
    if name == "Any":
        return r"\x00-\x{10FFFF}" if not negate else r"&&[^\x00-\x{10FFFF}]"
    spelled = name if _CATEGORY.fullmatch(name) else "Is" + name
    return f"\\{'P' if negate else 'p'}{{{spelled}}}"


def _escape(r: _Reader, in_class: bool) -> str:
    """The escape after a backslash; in a class the result is set contents."""
    if r.done():
        raise _bad(r.text, "trailing backslash")
    char = r.take()
    if char in _SETS:
        return _SETS[char] if in_class else f"[{_SETS[char]}]"
    if char in _SIMPLE:
        return _SIMPLE[char]
    if char in "pP":
        return _property(r, char == "P")
    if char == "x":
        code = r.match(re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})"))
        if not code:
            raise _bad(r.text, "bad \\x")
        return f"\\x{{{code[1] or code[2]}}}"
    if char in "01234567":
        digits = char + r.match(re.compile("[0-7]{0,2}"))[0]
        if char != "0" and len(digits) == 1:
            raise _bad(r.text, "backreference")
        return f"\\x{{{int(digits, 8):X}}}"
    if not in_class:
        if char == "b":
            return _BOUNDARY
        if char == "B":
            return _NO_BOUNDARY
        if char in "Az":
            return "\\" + char
    if char.isascii() and not char.isalnum():
        return _literal(char)
    raise _bad(r.text, f"unknown escape \\{char}")


def _one_of_class(r: _Reader) -> tuple[str, int | None]:
    """The next member of a class and, where it is a single character, its code point."""
    char = r.take()
    if char != "\\":
        return (char if char == "-" else _literal(char)), ord(char)
    start = r.at
    spelled = _escape(r, in_class=True)
    escape = r.text[start:r.at]
    if escape[0] in _SETS or escape[0] in "pP":
        return spelled, None
    if spelled.startswith("\\x{"):
        return spelled, int(spelled[3:-1], 16)
    codes = {r"\f": 12, r"\n": 10, r"\r": 13, r"\t": 9, r"\x07": 7, r"\x0B": 11}
    return spelled, codes.get(spelled, ord(escape[0]))


def _char_class(r: _Reader) -> str:
    out = "[" + (r.take() if r.rest("^") else "")
    first = True
    while True:
        if r.done():
            raise _bad(r.text, "unclosed class")
        if r.rest("]") and not first:
            r.take()
            return out + "]"
        first = False
        named = r.match(re.compile(r"\[:(\^?)(\w+):\]"))
        if named:
            if named[2] not in _POSIX:
                raise _bad(r.text, f"unknown class {named[0]}")
            out += f"[^{_POSIX[named[2]]}]" if named[1] else _POSIX[named[2]]
            continue
        low, low_code = _one_of_class(r)
        ranged = low_code is not None and r.rest("-") and r.at + 1 < len(r.text) and r.text[r.at + 1] != "]"
        if not ranged:
            out += "\\-" if low == "-" else low
            continue
        r.take()
        high, high_code = _one_of_class(r)
        if high_code is None or high_code < low_code:
            raise _bad(r.text, "bad range")
        out += "-".join("\\-" if x == "-" else x for x in (low, high))


def to_java(pattern: str) -> str:
    """The pattern for ``rlike``."""
    r, out, scopes = _Reader(pattern), "(?d)", [{"m": False}]
    repeatable, names = False, set()
    while not r.done():
        flags = scopes[-1]
        repeat = r.match(_REPEAT) if repeatable else None
        if repeat:
            low, high = int(repeat[1]), int(repeat[2] or repeat[1])
            if high < low or high > _MOST_REPEATS or low > _MOST_REPEATS:
                raise _bad(pattern, "bad repeat count")
        if repeat or (repeatable and r.text[r.at] in "*+?"):
            out += (repeat[0] if repeat else r.take()) + (r.take() if r.rest("?") else "")
            if not r.done() and (r.text[r.at] in "*+?" or _REPEAT.match(r.text, r.at)):
                raise _bad(pattern, "repeated repetition")
            repeatable = False
            continue
        char, repeatable = r.take(), True
        if char == "\\":
            if r.rest("Q"):
                r.take()
                end = r.text.find("\\E", r.at)
                body = r.take((end if end >= 0 else len(r.text)) - r.at)
                r.take(2)
                out += "".join(map(_literal, body))
            else:
                out += _escape(r, in_class=False)
        elif char == "[":
            out += _char_class(r)
        elif char == "^":
            out += r"(?<![^\n])" if flags["m"] else r"\A"
        elif char == "$":
            out += r"(?![^\n])" if flags["m"] else r"\z"
        elif char == "(":
            repeatable = False
            if not r.rest("?"):
                out, scopes = out + "(?:", scopes + [dict(flags)]
                continue
            r.at -= 1
            group = r.match(_GROUP)
            if not group:
                raise _bad(pattern, "unsupported group")
            if group[1]:
                if group[1] in names:
                    raise _bad(pattern, f"duplicate group name {group[1]}")
                names.add(group[1])
            switch = group[2] or ""
            on, _, off = switch.partition("-")
            scope = {"m": (flags["m"] or "m" in on) and "m" not in off}
            spelled = on.replace("m", "").replace("U", "").replace("i", "iu")
            dropped = off.replace("m", "").replace("U", "").replace("i", "iu")
            spelled += "-" + dropped if dropped else ""
            if group[3] == ")":
                scopes[-1] = scope
                out += f"(?{spelled})" if spelled else ""
            else:
                scopes.append(scope)
                out += f"(?{spelled}:"
        elif char == ")":
            if len(scopes) == 1:
                raise _bad(pattern, "unexpected )")
            scopes.pop()
            out += ")"
        elif char == "|":
            out, repeatable = out + "|", False
        elif char in "*+?":
            raise _bad(pattern, "nothing to repeat")
        elif char == ".":
            out += "."
        else:
            out += _literal(char)
    if len(scopes) > 1:
        raise _bad(pattern, "missing )")
    return out


@dataclass
class _Group:
    """What the reader of a group has seen: repeats or alternatives in it, and literal runs of its branches."""

    nested: bool = False
    branches: list[list[str]] = field(default_factory=lambda: [[]])
    run: str = ""

    def close(self) -> None:
        if len(self.run) >= _SHORTEST:
            self.branches[-1].append(self.run)
        self.run = ""


def _survey(pattern: str) -> tuple[bool, list[list[str]]]:
    """Whether matching may backtrack without bound, and the strings each top branch needs; of a pattern ``to_java`` takes."""
    r, groups, open_repeats, risky, folded = _Reader(pattern), [_Group()], 0, False, False
    last: str | _Group | None = None  # what a repeat would apply to: a character, a group, or neither
    while not r.done():
        here = groups[-1]
        repeat = r.match(_REPEAT) if last is not None else None
        if last is not None and (repeat or r.text[r.at] in "*+?"):
            mark = repeat[0] if repeat else r.take()
            low = int(repeat[1]) if repeat else int(mark == "+")
            many = mark in ("*", "+") or bool(repeat) and (repeat[2] == "" or int(repeat[2] or low) > 1)
            if r.rest("?"):
                r.take()
            if isinstance(last, str) and last and here.run:
                here.run = here.run if low else here.run[:-1]
            here.close()
            here.nested = True
            open_repeats += mark in ("*", "+") or bool(repeat) and repeat[2] == ""
            risky = risky or many and isinstance(last, _Group) and last.nested
            last = None
            continue
        char, last = r.take(), ""
        if char == "\\" and r.rest("Q"):
            end = r.text.find("\\E", r.at)
            body = r.take((end if end >= 0 else len(r.text)) - r.at)[1:]
            r.take(2)
            here.run, last = here.run + body, body[-1:]
        elif char == "\\":
            escaped = r.text[r.at]
            _escape(r, in_class=False)
            if escaped.isascii() and not escaped.isalnum():
                here.run, last = here.run + escaped, escaped
            else:
                here.close()
        elif char == "[":
            _char_class(r)
            here.close()
        elif char == "(":
            here.close()
            r.at -= 1
            group = r.match(_GROUP)
            if group is None:
                r.at += 1
            folded = folded or "i" in (group[2] or "" if group else "")
            if group is None or group[3] != ")":
                groups.append(_Group())
            last = None
        elif char == ")":
            here.close()
            last = groups.pop()
            groups[-1].nested = groups[-1].nested or last.nested
        elif char == "|":
            here.close()
            here.branches.append([])
            here.nested = True
            last = None
        elif char in "^$.":
            here.close()
        else:
            here.run, last = here.run + char, char
    groups[0].close()
    strings = groups[0].branches
    return risky or open_repeats > _OPEN_REPEATS, strings if all(strings) and not folded else []


def backtracks(pattern: str) -> bool:
    """Whether Java may take more than quadratic time: a repeat around repeats or alternatives, or many open repeats."""
    return _survey(pattern)[0]


def required_strings(pattern: str) -> list[list[str]]:
    """For each top alternative strings that all of its matches hold; empty where nothing is known."""
    return _survey(pattern)[1]


def found_in(text: Column, pattern: str) -> Column:
    """Whether the pattern (RE2 syntax) is found in a text; ``ValueError`` for a bad one."""
    java = to_java(pattern)
    if backtracks(pattern):
        def linear(texts: pa.Array) -> pa.Array:
            return pc.match_substring_regex(texts, pattern)

        found = F.arrow_udf(linear, "boolean")(text)
    else:
        found = text.rlike(java)
    needs = [reduce(and_, [text.contains(s) for s in branch]) for branch in required_strings(pattern)]
    return reduce(or_, needs) & found if needs else found

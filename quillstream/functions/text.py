"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text tools see it, control separators included; the
#: same class in Java's and RE2's notation.
SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters for trimming, which takes no pattern and looks at the ends alone.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_OTHER = r"[\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Character maps.
WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
ACCENTED = "ÂâÊêÎîÔôÛûÇçÑñÜüÖöÄä"
PLAIN = "AaEeIiOoUuCcNnUuOoAa"
CJK_MARKS = "，。！？；：‘’“”（）【】《》、—－"
ASCII_MARKS = ",.!?;:''\"\"()[]<>/--"
ELLIPSIS = "…"


@dataclass(frozen=True)
class Cleaning:
    whitespace: bool = True
    width: bool = True
    accents: bool = True
    punctuation: bool = True
    newlines: bool = True
    most_newlines: int = 2


#: A cleaner of one's own: a text column to a text column.
Cleaner = Callable[[Column], Column]
DEFAULT = Cleaning()
AGGRESSIVE = Cleaning(most_newlines=1)
LIGHT = Cleaning(width=False, accents=False, punctuation=False)


def named(**fields: Column) -> Column:
    """A struct whose names hold inside higher-order functions, where aliases are lost."""
    return F.named_struct(*[c for k, v in fields.items() for c in (F.lit(k), v)])


def let(value: Column, body) -> Column:
    """body over a value that is computed once: without it a deep expression holds
    a copy of the value at each place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space, line ends included, to one space; none at the ends."""
    # A single blank, the most frequent case, is left as it is.
    return F.trim(F.regexp_replace(c, f" {SPACE}+|{_OTHER}{SPACE}*", " "))


def clean(c: Column, how: Cleaning | Cleaner = DEFAULT) -> Column:
    """c cleaned by settings, or by a function of one's own."""
    if not isinstance(how, Cleaning):
        return how(c)
    if how.whitespace:
        c = collapse(c)
    if how.width:
        c = F.translate(c, WIDE, NARROW)
    if how.accents:
        c = F.translate(c, ACCENTED, PLAIN)
    if how.punctuation:
        c = F.translate(F.replace(c, F.lit(ELLIPSIS), F.lit("...")), CJK_MARKS, ASCII_MARKS)
    if how.newlines:
        c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), rf"\n{{{how.most_newlines + 1},}}", "\n" * how.most_newlines)
    return c


def markdown_heading(c: Column) -> Column:
    """A space after the hashes, none of them at the end."""
    c = F.regexp_replace(c, r"^(#{1,6})([^\s#])", "$1 $2")
    return strip(F.regexp_replace(c, r"\s*#+\s*$", ""))


def markdown_code(c: Column) -> Column:
    """First and last line without white space around them."""
    lines = F.split(c, "\n")
    return F.array_join(F.transform(lines, lambda x, i: F.when((i == 0) | (i == F.size(lines) - 1), strip(x)).otherwise(x)), "\n")


def markdown_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\s*([^\]]*?)\s*\]\(\s*([^)]*?)\s*\)", "[$1]($2)")


def markdown_lists(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^([ \t]*)[*+-][ \t]+", "$1- ")


_HAN, _LETTER, _DIGIT = r"\x{4e00}-\x{9fff}", "a-zA-Z", "0-9"


def ocr_glue(c: Column) -> Column:
    """Spaces that recognition put inside and between runs of Han, letters and digits go."""
    for one in (_HAN, _LETTER, _DIGIT):
        c = F.regexp_replace(c, rf"(?<=[{one}])\s+(?=[{one}])", "")
    for a, b in ((_HAN, _LETTER), (_LETTER, _HAN), (_HAN, _DIGIT), (_DIGIT, _HAN), (_LETTER, _DIGIT), (_DIGIT, _LETTER)):
        c = F.regexp_replace(c, rf"(?<=[{a}])\s+(?=[{b}])", "")
    return c


#: Digits that recognition takes for letters. Fixed values.
LOOKALIKE = {"0": "o", "1": "l", "5": "s", "8": "s", "6": "b"}


def ocr_letters(c: Column) -> Column:
    """Digits between letters, in runs of one or two, become the letters they look like."""
    for digit, letter in LOOKALIKE.items():
        near = "a-z" if digit in "01" else "a-zA-Z"
        whole = rf"(?<=[a-zA-Z])(?<=[{near}]){digit}(?=[0-9]?[a-zA-Z])|(?<=[a-zA-Z][0-9]){digit}(?=[{near}])"
        c = F.regexp_replace(c, whole, letter)
    return c

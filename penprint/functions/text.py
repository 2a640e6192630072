"""Text and array expressions (X1, X2, X4–X6, X11–X15, X21, X23, F1–F11 helpers).

Every function returns a ``Column``; whole documents are processed inside one
projection (``split``/``transform``/``slice`` run JVM-side), so encoding a
file never explodes it into rows or collects it back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions.rng import h

# ---- fixed values: the character table of the character encoder -------------
# Characters in id order after the two markers (96 characters, in this order):
CHAR_TABLE = ("qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM\n\r\t "
              "1234567890-=!@#$%^&*()_+[]{}|;':\\\",./<>?")
# File-encoder order: <end> = 0, <start> = 1, characters 2..97, unknown 98.
# Dataset order:      <start> = 0, <end> = 1, characters 2..97, unknown 98.
CHAR_OOV = len(CHAR_TABLE) + 2
# Subword cleaning symbols.
TAB_SYMBOL = "[TAB]"
EOL_SYMBOL = "[EOL]"
# ------------------------------------------------------------------------------

# Unicode white space, as Python's ``\\s`` has it (the same spelling works in Java and RE2).
WS_SET = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CLASS = f"[{WS_SET}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(text) -> Column:
    """Unicode code points of ``text`` as an array of 1-char strings (none for
    the empty text)."""
    return F.when(F.length(_c(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(_c(text), ""))


def char_encode(text, order: str = "file") -> Column:
    """[start, ids..., end] with ids from the fixed table, unknown -> 98.

    All table characters are ASCII, so the id is an O(1) index into a
    128-entry array by code point (no search per character)."""
    lut = [None] * 128
    for i, ch in enumerate(CHAR_TABLE):
        lut[ord(ch)] = i + 2
    lut_col = F.array(*[F.lit(v).cast("int") for v in lut])
    start, end = (1, 0) if order == "file" else (0, 1)
    ids = F.transform(chars(text), lambda ch: F.coalesce(
        F.try_element_at(lut_col, F.ascii(ch) + 1), F.lit(CHAR_OOV)))
    return F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))


def binary_encode(ids, plus_one: bool = False) -> Column:
    """8 bits (most significant first) of every id (or id + 1)."""
    return F.transform(_c(ids), lambda i: F.transform(
        F.sequence(F.lit(7), F.lit(0), F.lit(-1)),
        lambda b: F.call_function("shiftright", i + F.lit(1 if plus_one else 0), b).bitwiseAND(F.lit(1))))


UNIT_ROWS = 512  # depths up to this have all their one-hot rows in one constant


def one_hot(ids, depth: int, length: int | None = None) -> Column:
    """One row of ``depth`` zeros and ones for each id; an id outside
    [0, depth) — the unknown id — gives a zero row, and so does the padding up
    to ``length`` rows.

    The rows are looked up in a constant table (up to ``UNIT_ROWS`` of them, else
    cut from a constant line of zeros around a one), so no expression is evaluated
    for each cell."""
    line = F.concat(F.array_repeat(F.lit(0), F.lit(depth)), F.array(F.lit(1)), F.array_repeat(F.lit(0), F.lit(depth - 1)))
    at = lambda i: F.when((i >= 0) & (i < depth), i).otherwise(depth).cast("int")
    if depth <= UNIT_ROWS:
        units = F.array(*[F.slice(line, depth + 1 - i, depth) for i in range(depth + 1)])  # the last is the zero row
        rows = F.transform(_c(ids), lambda i: F.get(units, at(i)))
    else:
        rows = F.transform(_c(ids), lambda i: F.slice(line, F.lit(depth + 1) - at(i), F.lit(depth)))
    if length is None:
        return rows
    zero = F.array_repeat(F.lit(0), F.lit(depth))
    return F.concat(F.slice(rows, 1, length), F.array_repeat(zero, F.greatest(F.lit(length) - F.size(rows), F.lit(0))))


def clean_for_subwords(text) -> Column:
    """X4 (program form): drop NUL, tab -> [TAB], newline -> [EOL]."""
    t = F.regexp_replace(_c(text), "\u0000", "")
    t = F.regexp_replace(t, "\t", TAB_SYMBOL.replace("[", "\\[").replace("]", "\\]"))
    return F.regexp_replace(t, "\n", EOL_SYMBOL.replace("[", "\\[").replace("]", "\\]"))


def clean_lines_for_subwords(text) -> Column:
    """X4 (encoder by-line form): every line, the last included, + '[EOL]\\n'."""
    t = F.regexp_replace(F.regexp_replace(_c(text), "\u0000", ""), "\t", "\\[TAB\\]")
    return F.transform(F.split(t, "\n", -1), lambda ln: F.concat(ln, F.lit(EOL_SYMBOL + "\n")))


def trainer_text(text) -> Column:
    """X4 (vocabulary trainer form): '[EOL]' before every newline, not after the
    last line; NUL dropped, tabs -> [TAB]."""
    t = F.regexp_replace(F.regexp_replace(_c(text), "\u0000", ""), "\t", "\\[TAB\\]")
    return F.regexp_replace(t, "\n", "\\[EOL\\]\n")


def whitespace_keeping_split(text) -> Column:
    """``re.split('(\\s+)', text)`` — words and separators alternate, with an
    empty first/last item when the text starts/ends with whitespace."""
    toks = F.regexp_extract_all(_c(text), F.lit(f"({WS_CLASS}+|[^{WS_SET}]+)"), 1)
    lead = F.when(_c(text).rlike(f"^{WS_CLASS}") | (F.length(_c(text)) == 0), F.array(F.lit(""))) \
        .otherwise(F.array().cast("array<string>"))
    trail = F.when(_c(text).rlike(f"{WS_CLASS}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, toks, trail)


def crop_prefix_with_end(ids, length: int, eos: int = 2) -> Column:
    """X11: first min(n, L) - 2 ids between two ``eos`` markers (length min(n, L)).
    With fewer than two ids (F5 filters such rows before) there is one marker
    for each id."""
    m = F.least(F.size(_c(ids)), F.lit(length))
    inner = F.slice(_c(ids), F.lit(1), F.greatest(m - 2, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(eos), F.greatest(F.least(m, F.lit(1)), F.lit(0))), inner,
                    F.array_repeat(F.lit(eos), F.when(m >= 2, 1).otherwise(0)))


def pad_to(ids, length: int, value: int = 0) -> Column:
    """Truncate or right-pad with ``value`` to exactly ``length``."""
    a = F.slice(_c(ids), 1, length)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def random_crop(text, length: int, seed, *key) -> Column:
    """A window of ``length`` characters starting uniformly in
    [0, len - length] (whole text when shorter), right-padded with NUL."""
    n = F.length(_c(text))
    start = F.pmod(h(seed, "crop", *key), F.greatest(n - length + 1, F.lit(1)))
    cut = F.when(n > length, F.substring(_c(text), start + 1, length)).otherwise(_c(text))
    return F.rpad(cut, length, "\u0000")


def truncate_lines(text, max_lines: int, max_len: int) -> Column:
    """The first ``max_lines`` lines, each cut to ``max_len`` characters."""
    return F.transform(F.slice(F.split(_c(text), "\n", -1), 1, max_lines), lambda ln: F.left(ln, F.lit(max_len)))


def truncate_text(text, max_len: int) -> Column:
    """First ``max_len`` characters."""
    return F.left(_c(text), F.lit(max_len))


def cut_bytes(text, max_len: int) -> Column:
    """X14, X15 as the reference cuts: the first ``max_len`` UTF-8 bytes, which may
    end inside a character (so the result is binary)."""
    return F.substring(_c(text).cast("binary"), 1, max_len)


def cut_line_bytes(text, max_lines: int, max_len: int) -> Column:
    """X14 in bytes: the first ``max_lines`` lines, each cut to ``max_len`` bytes."""
    return F.transform(F.slice(F.split(_c(text), "\n", -1), 1, max_lines),
                       lambda ln: F.substring(ln.cast("binary"), 1, max_len))


def concat_pair(a, b, separator) -> Column:
    """File 1, one separator element, file 2."""
    return F.concat(_c(a), F.array(separator), _c(b))


def file_extension(path) -> Column:
    """F1 helper: text after the last dot of the last path component ('' if none)."""
    return F.regexp_extract(_c(path), r"\.([^./]*)$", 1)


def format_ordinal(n, name) -> Column:
    """X21: '{:03d} {}'."""
    return F.format_string("%03d %s", _c(n), _c(name))


def numeric_user_id(user_id, prefix_len: int = 1) -> Column:
    """int(user_id[prefix_len:])."""
    return F.substring(_c(user_id), prefix_len + 1, 1 << 30).cast("bigint")


def flip_label(label) -> Column:
    """The intended 1 - label."""
    return F.lit(1) - _c(label)

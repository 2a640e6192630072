"""Regex lexer for C-family sources (X9) and the lexer-token encoder.

The external lexer binary is replaced by one ordered regular expression, run
with ``regexp_extract_all`` over the whole file (JVM-side, no Python).  Tokens
are classified by anchored patterns in the same order; identifiers that are
keywords become ``keyword``.  Characters that start no token (e.g. non-ASCII
letters, ``\\r``) are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
# Token classes and their ids.
CLASS_IDS = {"s": 3, "t": 4, "c": 5, "lc": 6, "newline": 7, "integer": 8, "floating": 9,
             "char": 10, "string": 11, "preprocessor": 12}
# Identifier spelling alphabet (ids start at 13).
ALPHABET = "_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ALPHABET_BASE = 13
# Operators in id order (ids start at 76): one, two and three characters.
OPERATORS = [
    "{", "}", "[", "]", "(", ")", ";", "?", "~", ",", "@", "<", ":", ".", "-", "+", "*", "/",
    "%", "^", "&", "|", "=", "!", ">",
    "<:", "<%", "<=", "<<", ":>", "::", ".*", "->", "-=", "--", "+=", "++", "*=", "/=", "%>",
    "%=", "^=", "&=", "&&", "|=", "||", "==", "!=", ">=", ">>",
    "...", "<=>", "->*", "<<=",
]
OPERATOR_BASE = ALPHABET_BASE + len(ALPHABET)          # 76
KEYWORD_BASE = OPERATOR_BASE + len(OPERATORS)          # 130 (disjoint ids)
QUIRK_KEYWORD_BASE = ALPHABET_BASE + len(OPERATORS)    # 67 (the reference's overlapping ids)
# C++20 keywords, in order (95).
CPP_KEYWORDS = (
    "alignas alignof and and_eq asm atomic_cancel atomic_commit atomic_noexcept auto bitand bitor bool "
    "break case catch char char16_t char32_t char8_t class co_await compl concept const const_cast "
    "consteval constexpr constinit continue co_return co_yield decltype default delete do double "
    "dynamic_cast else enum explicit export extern false float for friend goto if inline int long "
    "mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public "
    "register reinterpret_cast requires return short signed sizeof static static_assert static_cast "
    "struct switch template this thread_local throw true try typedef typeid typename union unsigned "
    "using virtual void volatile wchar_t while xor xor_eq"
).split()
# Java keywords, in order (51).
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else "
    "enum extends final finally float for goto if implements import instanceof int interface long "
    "native new null package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while"
).split()
# ------------------------------------------------------------------------------


def _esc(op: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\/-" else ch for ch in op)


_OPS_LONGEST_FIRST = sorted(OPERATORS, key=lambda o: -len(o))

# Ordered alternatives: (class, pattern).  Identical syntax in Java and RE2.
TOKEN_RULES = [
    ("preprocessor", r"#[^\n]*"),
    ("lc", r"//[^\n]*"),
    ("c", r"/\*[\s\S]*?\*/"),
    ("string", r'"(?:[^"\\\n]|\\.)*"'),
    ("char", r"'(?:[^'\\\n]|\\.)*'"),
    ("floating", r"(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFlL]?|[0-9]+[eE][+-]?[0-9]+[fFlL]?"),
    ("integer", r"0[xX][0-9a-fA-F]+[uUlL]*|[0-9]+[uUlL]*"),
    ("identifier", r"[A-Za-z_][A-Za-z_0-9]*"),
    ("operator", "|".join(_esc(o) for o in _OPS_LONGEST_FIRST)),
    ("s", r" "),
    ("t", r"\t"),
    ("newline", r"\n"),
]
TOKEN_PATTERN = "|".join(f"(?:{p})" for _, p in TOKEN_RULES)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lex(text) -> Column:
    """Array of token strings in source order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


def _is_digit(ch: Column) -> Column:
    return (ch >= F.lit("0")) & (ch <= F.lit("9"))


def _is_ident_start(ch: Column) -> Column:
    return ((ch >= F.lit("a")) & (ch <= F.lit("z"))) | ((ch >= F.lit("A")) & (ch <= F.lit("Z"))) | (ch == F.lit("_"))


def _number_class(tok: Column) -> Column:
    """For a token that starts with a digit: hex -> integer, '.'/exponent -> floating."""
    return (F.when(F.lower(F.substring(tok, 1, 2)) == F.lit("0x"), F.lit("integer"))
            .when((F.instr(tok, ".") > 0) | (F.instr(tok, "e") > 0) | (F.instr(tok, "E") > 0), F.lit("floating"))
            .otherwise(F.lit("integer")))


def token_class(tok: Column, keywords=CPP_KEYWORDS) -> Column:
    """Class of a token emitted by ``lex``.  Every token matches exactly the
    alternative that produced it, and the alternatives are told apart by their
    first one or two characters, so no regular expression is needed here (the
    SQL oracle classifies with the anchored patterns and must agree)."""
    f = F.substring(tok, 1, 1)
    kw = F.array(*[F.lit(k) for k in keywords])
    return (F.when(f == "#", F.lit("preprocessor"))
            .when(tok.startswith("//"), F.lit("lc"))
            .when(tok.startswith("/*"), F.lit("c"))
            .when(f == '"', F.lit("string"))
            .when(f == "'", F.lit("char"))
            .when(_is_digit(f), _number_class(tok))
            .when((f == ".") & _is_digit(F.substring(tok, 2, 1)), F.lit("floating"))
            .when(_is_ident_start(f), F.when(F.array_contains(kw, tok), F.lit("keyword"))
                  .otherwise(F.lit("identifier")))
            .when(tok == " ", F.lit("s"))
            .when(tok == "\t", F.lit("t"))
            .when(tok == "\n", F.lit("newline"))
            .otherwise(F.lit("operator")))


def lex_source(text, keywords=CPP_KEYWORDS) -> Column:
    """array<struct<class, token>> for the whole text."""
    return F.transform(lex(text), lambda t: F.struct(token_class(t, keywords).alias("class"), t.alias("token")))


def spell(tok: Column) -> Column:
    """Identifier spelled character by character: '_' 13, a-z 14-39, A-Z 40-65,
    0-9 66-75 (the alphabet order), by code-point arithmetic."""
    def one(ch):
        c = F.ascii(ch)
        return (F.when(c == 95, F.lit(ALPHABET_BASE))
                .when(c >= 97, c - 97 + ALPHABET_BASE + 1)
                .when(c >= 65, c - 65 + ALPHABET_BASE + 27)
                .otherwise(c - 48 + ALPHABET_BASE + 53)).cast("int")
    return F.transform(F.split(tok, ""), one)


def _lit_map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(int(v)))])


def encode_tokens(text, reserved: list[str] | None = None, keywords=CPP_KEYWORDS,
                  keyword_base: int = KEYWORD_BASE, spell_reserved_too: bool = False) -> Column:
    """X9 + X10 on a text column (see ``encode_token_array``)."""
    return encode_token_array(lex(text), reserved, keywords, keyword_base, spell_reserved_too)


def encode_token_array(tokens, reserved: list[str] | None = None, keywords=CPP_KEYWORDS,
                       keyword_base: int = KEYWORD_BASE, spell_reserved_too: bool = False) -> Column:
    """X9 + X10: lexer-token ids of a whole text, in one projection.

    Class ids 3–12, operators from 76, keywords from ``keyword_base`` (default
    disjoint 130; the reference's 67 overlaps alphabet/operator ids), reserved
    identifiers (K1's list) after the keywords, other identifiers spelled.
    ``spell_reserved_too`` reproduces the reference emitting both.
    """
    reserved = reserved or []
    reserved_base = keyword_base + len(keywords)
    words = _lit_map([(k, keyword_base + i) for i, k in enumerate(keywords)]
                     + [(r, reserved_base + i) for i, r in enumerate(reserved) if r not in keywords])
    ops = _lit_map([(o, OPERATOR_BASE + i) for i, o in enumerate(OPERATORS)])
    num = {"integer": CLASS_IDS["integer"], "floating": CLASS_IDS["floating"]}

    def one(tok: Column) -> Column:
        f = F.substring(tok, 1, 1)
        hit = F.map_contains_key(words, tok)
        word_id = F.array(F.element_at(words, tok))
        if spell_reserved_too:
            ident = F.when(hit & F.array_contains(F.array(*[F.lit(k) for k in keywords]), tok), word_id) \
                .when(hit, F.concat(word_id, spell(tok))).otherwise(spell(tok))
        else:
            ident = F.when(hit, word_id).otherwise(spell(tok))
        number = F.when(_number_class(tok) == "floating", F.lit(num["floating"])).otherwise(F.lit(num["integer"]))
        return (F.when(f == "#", F.array(F.lit(CLASS_IDS["preprocessor"])))
                .when(tok.startswith("//"), F.array(F.lit(CLASS_IDS["lc"])))
                .when(tok.startswith("/*"), F.array(F.lit(CLASS_IDS["c"])))
                .when(f == '"', F.array(F.lit(CLASS_IDS["string"])))
                .when(f == "'", F.array(F.lit(CLASS_IDS["char"])))
                .when(_is_digit(f), F.array(number))
                .when((f == ".") & _is_digit(F.substring(tok, 2, 1)), F.array(F.lit(CLASS_IDS["floating"])))
                .when(_is_ident_start(f), ident)
                .when(tok == " ", F.array(F.lit(CLASS_IDS["s"])))
                .when(tok == "\t", F.array(F.lit(CLASS_IDS["t"])))
                .when(tok == "\n", F.array(F.lit(CLASS_IDS["newline"])))
                .otherwise(F.array(F.element_at(ops, tok))))

    return F.flatten(F.transform(_c(tokens), one))


def identifiers(text, keywords=CPP_KEYWORDS) -> Column:
    """Identifier tokens (keywords excluded) of a whole text."""
    return identifier_tokens(lex(text), keywords)


def identifier_tokens(tokens, keywords=CPP_KEYWORDS) -> Column:
    """Identifier tokens (keywords excluded) of a lexed token array."""
    kw = F.array(*[F.lit(k) for k in keywords])
    return F.filter(_c(tokens), lambda t: _is_ident_start(F.substring(t, 1, 1)) & ~F.array_contains(kw, t))


def vocabulary_size(encoding: str, n_reserved: int = 0, keywords=CPP_KEYWORDS,
                    keyword_base: int = KEYWORD_BASE, subword_vocab: int | None = None) -> int:
    """Size of the id space of an encoding."""
    if encoding == "chars":
        return 96 + 2 + 1
    if encoding == "tokens":
        return keyword_base + len(keywords) + n_reserved
    if encoding == "subwords":
        if subword_vocab is None:
            raise ValueError("subword vocabulary size required")
        return subword_vocab
    raise ValueError(encoding)

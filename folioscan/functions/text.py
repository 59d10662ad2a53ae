"""Text semantics as SQL expressions: decoding, line splitting, stripping,
the regular-expression dialect, and locating every match of a pattern.

Every function takes and returns the text of a SQL expression, to be used with
``F.expr`` or ``selectExpr``; everything stays on the JVM side.  The rules were written against a
dialect in which ``\\s`` is any Unicode white space, ``\\w`` any Unicode letter or
digit or ``_``, and ``.`` any character but ``\\n``; :func:`jregex` spells those
classes out for Java, :func:`re2` for RE2 engines.  ``\\b`` is used only at the
ends of a pattern, next to a word character, where it means "no word character
on the other side".
"""

from __future__ import annotations

import re

# White space and line boundaries as str.isspace / str.splitlines
# define them.  The \x{..} escapes are understood by Java and RE2 alike.
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK_CLASS = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CHARS = "".join(
    chr(c) for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Chinese characters and the circled digit one: what non-ASCII literals consist of.
HAN_CLASS = r"\x{2460}\x{4e00}-\x{9fff}"
HAN_RANGE = chr(0x2460) + chr(0x4E00) + "-" + chr(0x9FFF)

# Characters which equal an ASCII letter only when case is ignored and which
# lower() does not map to it: dotted I, dotless i, long s.
FOLDING_CHARS = chr(0x130) + chr(0x131) + chr(0x17F)

# Non-characters used as an insertion mark, and the stand-in for a mark that
# the text already holds.
_MARK, _MARK_STANDIN = chr(0xFFFF), chr(0xFFFE)
_REPLACEMENT_CHAR = chr(0xFFFD)


def _expand(pattern: str, left: str, right: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
        elif two == r"\w":
            out.append(WORD_CLASS if in_class else f"[{WORD_CLASS}]")
        elif two == r"\b":
            out.append(right if out else left)
        elif two[0] == "\\":
            out.append(two)
        else:
            if two[0] == "[":
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def jregex(pattern: str) -> str:
    """The pattern for Spark's (Java's) engine; ``\\n`` is the only line end."""
    literal = re.match(r"\\b((?:\w|\\\.)+)(?=\\|$)", pattern)
    if literal:
        # Literal first, then the look back over it: the engine can skip through
        # the text to the literal instead of looking back at every character.
        word = literal.group(1)
        pattern = f"{word}(?<![{WORD_CLASS}]{word})" + pattern[literal.end():]
    body = _expand(pattern, f"(?<![{WORD_CLASS}])", f"(?![{WORD_CLASS}])")
    return "(?d)" + body.replace("(?i)", "(?iu)")


def re2(pattern: str) -> str:
    """The pattern for RE2 engines, where ``\\b`` knows ASCII only."""
    return "(?-s)" + _expand(pattern, r"\b", r"\b")


def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def decode_utf8(raw: str) -> str:
    """Bytes to text, dropping invalid sequences and keeping a real U+FFFD."""
    bad, keep = q(_REPLACEMENT_CHAR), q(_MARK_STANDIN + _MARK)
    kept = f"replace(CAST({raw} AS STRING), {bad}, {keep})"
    return f"replace(replace(make_valid_utf8({kept}), {bad}, ''), {keep}, {bad})"


def unify_newlines(text: str) -> str:
    return f"replace(replace({text}, '\\r\\n', '\\n'), '\\r', '\\n')"


def split_lines_loosely(text: str) -> str:
    """Lines of a text, and an empty one after a final line boundary."""
    return f"split({text}, {q(f'[{BREAK_CLASS}]')}, -1)"


def splitlines(text: str) -> str:
    """Lines of a text; no empty line after a final line boundary."""
    parts = split_lines_loosely(text)
    ends = f"({text} = '' OR substring({text}, -1, 1) RLIKE {q(f'[{BREAK_CLASS}]')})"
    return f"slice({parts}, 1, size({parts}) - CASE WHEN {ends} THEN 1 ELSE 0 END)"


def count_lines(text: str) -> str:
    """size(splitlines(text)); only texts with rare line boundaries are split."""
    rare = BREAK_CLASS.replace("\\n", "")
    newlines = f"length({text}) - length(replace({text}, '\\n', ''))"
    return (f"CASE WHEN {text} RLIKE {q(f'[{rare}]')} THEN size({splitlines(text)}) "
            f"ELSE {newlines} + CASE WHEN {text} = '' OR endswith({text}, '\\n') THEN 0 ELSE 1 END END")


def strip(text: str) -> str:
    return f"btrim({text}, {q(SPACE_CHARS)})"


def lstrip(text: str) -> str:
    return f"ltrim({q(SPACE_CHARS)}, {text})"


def not_blank(text: str) -> str:
    return f"({text} RLIKE {q(f'[^{SPACE_CLASS}]')})"


def suffix(path: str) -> str:
    """Extension with its dot, lower case; '' for names such as ``.gitignore``."""
    return f"lower(regexp_extract({path}, {q(r'[^/](\.[^./]+)$')}, 1))"


def file_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def is_in(value: str, options) -> str:
    return f"({value} IN ({', '.join(q(o) for o in options)}))"


def contains(text: str, literal: str) -> str:
    return f"contains({text}, {q(literal)})"


def contains_any(text: str, literals) -> str:
    return any_of(*[contains(text, w) for w in literals])


def contains_all(text: str, literals) -> str:
    return all_of(*[contains(text, w) for w in literals])


def has_han(text: str) -> str:
    return f"(octet_length({text}) > length({text}) AND {text} RLIKE {q(f'[{HAN_CLASS}]')})"


def contains_any_by_script(text: str, han: str, literals) -> str:
    """contains_any that looks for Chinese literals in Chinese texts only."""
    chinese = [w for w in literals if re.search(f"[{HAN_RANGE}]", w)]
    other = [w for w in literals if w not in chinese]
    parts = [contains_any(text, other)] if other else []
    if chinese:
        parts.append(f"({han} AND {contains_any(text, chinese)})")
    return any_of(*parts)


def contains_any_ci(text: str, lowered: str, folding: str, literals, han: str = "true") -> str:
    """Case-insensitive search for literals.

    Plain substring search in the lower-cased text; only texts holding one of
    FOLDING_CHARS need the (slower) pattern as well.
    """
    pattern = "(?iu)" + "|".join("\\Q" + w + "\\E" for w in literals)
    lower = [w.lower() for w in literals]
    return any_of(contains_any_by_script(lowered, han, lower), f"({folding} AND {text} RLIKE {q(pattern)})")


def rlike(text: str, pattern: str) -> str:
    return f"({text} RLIKE {q(jregex(pattern))})"


def count_matches(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {q(jregex(pattern))})"


def find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(jregex(pattern))}, {group})"


def matches(text: str, pattern: str) -> str:
    """Every match as ``array<struct<pos int, line int, match string>>``.

    ``line`` is one plus the number of ``\\n`` before the match.  A marker is set
    in front of each match; the number of markers on each line then gives the
    line numbers of all matches in one linear pass, however many there are.
    """
    mark, found = q(_MARK), q(jregex(pattern))
    marked = f"regexp_replace(translate({text}, {mark}, {q(_MARK_STANDIN)}), {found}, {q(_MARK + '$0')})"
    lines = (
        f"flatten(transform(split({marked}, '\\n', -1), "
        f"(l, i) -> array_repeat(i + 1, length(l) - length(replace(l, {mark}, '')))))"
    )
    return (
        f"transform(zip_with({lines}, regexp_extract_all({text}, {found}, 0), "
        "(l, m) -> struct(l AS line, m AS match)), (x, i) -> struct(i AS pos, x.line AS line, x.match AS match))"
    )


def token_estimate(text: str) -> str:
    """``int(len / 3.5)``; 0 for an empty text."""
    return f"CAST(floor(length({text}) / 3.5D) AS BIGINT)"

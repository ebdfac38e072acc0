"""Column helpers for text: pattern dialect, spans with offsets, rewriting, normal forms."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from veil import rules

_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD_START = r"(?<![A-Za-z0-9_])"
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

SPAN = "array<struct<start:int,type:string,value:string>>"


@lru_cache(maxsize=None)
def jvm(pattern: str) -> str:
    """The Java form of a rule pattern: ASCII word boundary, Unicode blanks, absolute end."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if pair == r"\s":
            out.append(_SPACES if in_class else f"[{_SPACES}]")
        elif pair == r"\S" and not in_class:
            out.append(f"[^{_SPACES}]")
        elif pair == r"\b" and not in_class:
            # At the head of a rule (or of a top-level alternative) a word character always follows.
            leading = "".join(out) in ("", "(?i)") or out[-1] == "|"
            out.append(_WORD_START if leading else _BOUNDARY)
        elif pattern[i] == "\\":
            out.append(pair)
        else:
            char = pattern[i]
            if char == "$" and not in_class:
                char = r"\z"
            elif char == "[":
                in_class = True
            elif char == "]":
                in_class = False
            out.append(char)
            i += 1
            continue
        i += 2
    return "".join(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(jvm(pattern))


def group(text: Column, pattern: str, index: int) -> Column:
    """Capture group of the first match, null when it is absent or empty."""
    return F.nullif(F.regexp_extract(text, jvm(pattern), index), F.lit(""))


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, jvm(pattern), replacement)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def trimmed(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def one_space(text: Column) -> Column:
    return trimmed(sub(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, every run outside [a-z0-9] one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.left(slug, F.lit(rules.SLUG_MAX))


def strip_volatile(text: Column) -> Column:
    out = F.lower(text)
    for pattern in rules.VOLATILE:
        out = sub(out, pattern, " ")
    return one_space(out)


def tokens(text: Column) -> Column:
    """Distinct blank-separated tokens."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def same_name(a: Column, b: Column) -> Column:
    """Two stable names denote one control: equal, truncated copy, or mostly shared tokens."""
    long = F.least(F.length(a), F.length(b)) >= rules.SIMILAR_PREFIX_MIN
    shared = F.size(F.array_intersect(tokens(a), tokens(b)))
    union = F.size(F.array_union(tokens(a), tokens(b)))
    return (
        F.when(a == b, True)
        .when((a == "") | (b == ""), False)
        .when(long & (a.startswith(b) | b.startswith(a)), True)
        .otherwise(F.coalesce(F.try_divide(shared, union) >= rules.SIMILARITY_MIN, F.lit(False)))
    )


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences without a negation word."""
    parts = F.transform(F.split(text, jvm(rules.SENTENCE_BREAK)), trimmed)
    return F.filter(parts, lambda s: (s != "") & ~has(s, rules.NEGATION))


# --- spans -------------------------------------------------------------------------


def no_spans() -> Column:
    return F.array().cast(SPAN)


def span(start: Column, kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(start.cast("int").alias("start"), kind.alias("type"), value.alias("value"))


def span_end(s: Column) -> Column:
    return s["start"] + F.length(s["value"])


#: Stands around matches; in texts it gives way to the other, which no pattern tells from it.
MARK, OTHER = "\x01", "\x02"


def marked(text: Column, pattern: str, parts: str = "$0") -> Column:
    """A text taken apart at the matches of a pattern: gap, the ``parts`` of a match (groups, parted by ``MARK``), gap and so on to the last gap.

    The pattern runs once. A split by the pattern itself would run it again, and compile it for every row.
    """
    clear = F.replace(text, F.lit(MARK), F.lit(OTHER))
    return F.split(F.regexp_replace(clear, jvm(pattern), MARK + parts + MARK), MARK, -1)


def match_list(text: Column, pattern: str, guard: Column, parts: list[str], place: int, none: Column, make) -> Column:
    """``make(start, match)`` of every match of a pattern, of the type of the empty array ``none``; ``match`` are its ``parts``, the one at
    ``place`` being the whole. Starts are a running sum over gaps and wholes.

    ``guard`` is a cheap necessary condition; the pattern itself runs only on rows that pass it.
    """
    per = len(parts) + 1

    def placed(pieces: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            piece = lambda k: F.get(pieces, n * per + k)
            whole, start = piece(place + 1), acc["at"] + F.length(piece(0))
            kept = F.when(F.contains(whole, F.lit(OTHER)), F.substring(text, start + 1, F.length(whole))).otherwise(whole)
            return F.struct((start + F.length(whole)).alias("at"), F.array_append(acc["out"], make(start, [
                kept if k == place else piece(k + 1) for k in range(len(parts))])).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / per).cast("int") - 1),
                           F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    every = let(marked(text, pattern, MARK.join(parts)), lambda pieces: F.when(F.size(pieces) > 1, placed(pieces)))
    return F.coalesce(F.when(guard, every), none)


def match_spans(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Every match of a pattern with its start."""
    return match_list(text, pattern, guard, ["$0"], 0, no_spans(), lambda start, match: span(start, kind, match[0]))


def claim(lists: list[Column]) -> Column:
    """Merge span lists in order of precedence; a span touching an accepted one is dropped. Sorted by start."""
    merged = F.aggregate(
        F.array(*lists), no_spans(),
        lambda taken, spans: F.concat(taken, F.filter(
            spans,
            lambda s: ~F.exists(taken, lambda t: (s["start"] < span_end(t)) & (span_end(s) > t["start"])),
        )),
    )
    return F.array_sort(merged)


def bounded_digits(text: Column, digits: Column) -> Column:
    """Whether a digit string occurs in the text with no digit on either side, i.e. is one of its digit runs."""
    return F.array_contains(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), digits)

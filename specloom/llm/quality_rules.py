"""Document quality rules: a threshold table compiled into one projection.

``measure`` adds one struct of counts per document, ``compile_rules`` turns a
table of thresholds over ratios of those counts into a single boolean column.
Everything is a built-in expression, so a scan, the counts and the verdict are
one stage without a shuffle.

Defined results: a null or empty text has zero words and fails the base rule;
copies and repeated rows are judged alike; a text of blanks only equals an empty
one; very long texts are counted whole; an input column called ``m``,
``base_failed`` or ``kept`` is passed on with an underscore appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, nested, unnested

# Frequent function words of the four languages judged.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by this are from or an at not a "
    "der die das und ist von mit den ein eine zu auf für im dem nicht auch es "
    "le la les de des et un une est que qui dans pour sur du par pas avec ce au en "
    "el los las y del una por con para su al se lo como más"
).split()

#: Index bits of a packed window; texts with more words are compared by struct.
INDEX_BITS = 21


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= ratio <= high``."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: Ratios are SQL over the struct ``m``; n_words is at least 1 in denominators.
RULES = (
    Rule("mean_word_length", "m.word_chars / greatest(m.n_words, 1)", 1.5, 25.0),
    Rule("symbols_per_word", "m.n_symbols / greatest(m.n_words, 1)", None, 0.25),
    Rule("stop_words_per_word", "m.n_stop_words / greatest(m.n_words, 1)", 0.005, None),
    Rule("duplicate_lines", "m.n_dup_lines / greatest(m.n_lines, 1)", None, 0.6),
    Rule("shouting_per_word", "m.n_shouts / greatest(m.n_words, 1)", None, 0.2),
)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return F.expr(f"m.n_words < {min_words} OR 100 * m.n_repeat_words > {repeat_percent} * m.n_words")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all thresholds of the table hold."""
    tests = [f"({r.ratio}) {op} {bound}D" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return F.expr(" AND ".join(f"({t})" for t in tests) or "true")


def window_hash(words: str, i: str) -> str:
    """SQL of the hash of the three words from ``i``."""
    return f"xxhash64({words}[{i}], {words}[{i} + 1], {words}[{i} + 2])"


def swept(places: str) -> str:
    """SQL of the words in windows at sorted ``places``: each adds what the one before it leaves uncovered."""
    return f"aggregate({places}, named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"


def _neighbours(windows: str, same) -> str:
    return f"filter({windows}, (x, k) -> {same('x', f'get({windows}, k - 1)')} OR {same('x', f'get({windows}, k + 1)')})"


def packed_words(words: str, bits: int) -> tuple[str, str]:
    """SQL over ``packed``: the words in repeated windows, and whether unequal windows share a hash.

    Windows are sorted by hash with their position packed into the low bits (a
    primitive sort) and neighbours with equal hash are compared word by word.
    Where two unequal ones meet, equal windows may lie apart: such a text counts
    by ``wide_words``.
    """
    low = (1 << bits) - 1
    h, p = (lambda x: f"shiftright({x}, {bits})"), (lambda x: f"cast({x} & {low} as int)")

    def equal(a: str, b: str) -> str:
        return " AND ".join(f"get({words}, {p(a)} + {k}) = get({words}, {p(b)} + {k})" for k in range(3))

    hit = _neighbours("packed", lambda a, b: f"coalesce({h(a)} = {h(b)} AND {equal(a, b)}, false)")
    before = "get(packed, k - 1)"
    clash = f"size(filter(packed, (x, k) -> coalesce({h('x')} = {h(before)} AND NOT ({equal('x', before)}), false))) > 0"
    return swept(f"array_sort(transform({hit}, x -> {p('x')}))"), clash


def wide_words() -> str:
    """SQL over ``wide``, windows sorted by hash, words and place: equal ones are neighbours always."""
    same = lambda a, b: f"coalesce({a}.h = {b}.h AND {a}.a = {b}.a AND {a}.b = {b}.b AND {a}.c = {b}.c, false)"
    return swept(f"array_sort(transform({_neighbours('wide', same)}, x -> x.i))")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``m`` of counts over the whole text.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words, n_stop_words, n_shouts (words ending in two or more ``!``).
    """
    return unnested(_measured(df, text), df, m=F.col("m"))


def _measured(df: DataFrame, text: str) -> DataFrame:
    """(row, m): the input row beside its counts."""
    low = (1 << INDEX_BITS) - 1
    inner = nested(df, F.coalesce(F.col(named(text)).cast("string"), F.lit("")).alias("t"))
    inner = inner.withColumn("s", F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM t)"))
    inner = inner.withColumn("w", F.expr(r"if(s = '', cast(array() as array<string>), split(s, '[ \\t-\\r]+'))"))
    inner = inner.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> trim(BOTH ' \t\u000B\u000C\r' FROM x) <> '')"))
    inner = inner.withColumn("last", F.expr("size(w) - 3"))
    hashed = window_hash("w", "i")
    inner = inner.withColumn("packed", F.expr(f"if(last < 0 OR last > {low}, cast(array() as array<bigint>), sort_array(transform(sequence(0, last), i -> (shiftleft({hashed}, {INDEX_BITS}) | cast(i as bigint)))))"))
    quick, clash = packed_words("w", INDEX_BITS)
    inner = inner.withColumn("apart", F.expr(f"last > {low} OR {clash}"))
    every = f"transform(sequence(0, last), i -> named_struct('h', {hashed}, 'a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'i', i))"
    inner = inner.withColumn("wide", F.expr(f"if(apart, array_sort({every}), cast(array() as array<struct<h:bigint,a:string,b:string,c:string,i:int>>))"))
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    m = F.struct(
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("aggregate(w, 0L, (a, x) -> a + char_length(x))").alias("word_chars"),
        F.expr("cast(char_length(t) - char_length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(f"if(apart, {wide_words()}, {quick})").alias("n_repeat_words"),
        F.expr(f"cast(size(filter(w, x -> lower(x) IN ({stop}))) as bigint)").alias("n_stop_words"),
        F.expr("cast(size(filter(w, x -> endswith(x, '!!'))) as bigint)").alias("n_shouts"),
    )
    return inner.select("row", m.alias("m"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus base_failed and kept."""
    out = _measured(df, text).withColumn("failed", base_failed())
    return unnested(out, df, m=F.col("m"), base_failed=F.col("failed"), kept=~F.col("failed") & compile_rules(rules))

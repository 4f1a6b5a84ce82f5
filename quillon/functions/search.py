"""Full-text search: tokens, matches and scores as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and word characters of the tokenizer.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = "A-Za-z0-9_"
#: Words of little meaning, for ``tokens(stop_words=True)``.
STOP_WORDS = (
    "a", "an", "the", "at", "by", "for", "from", "in", "into", "of", "off", "on", "onto", "out", "over", "to", "up", "with", "and",
    "but", "or", "nor", "so", "yet", "am", "are", "be", "been", "being", "did", "do", "does", "doing", "done", "had", "has", "have",
    "having", "is", "it", "its", "was", "were", "he", "her", "him", "his", "i", "me", "my", "she", "that", "them", "they", "this",
    "us", "we", "what", "which", "who", "you", "your", "as", "if", "not", "no", "yes", "all", "any", "can", "will", "just", "than",
    "then", "too", "very",
)
#: A token in lower-case text: from the first to the last word character between spaces. A blank, which ends most tokens, is
#: ruled out before the set of other marks is asked, which takes much longer; nothing is read twice but the marks behind a token.
TOKEN = rf"\w++(?:(?! )[^\w{SPACES}]++\w++)*+"
#: What stands before the token of its part of the text.
BEFORE = f"(?:^|[{SPACES}])[^{WORD}{SPACES}]*+"


def tokenize(text: str) -> list[str]:
    """The tokens of a query, as ``tokens`` makes them of columns."""
    parts = (re.sub(rf"^[^{WORD}]+|[^{WORD}]+\Z", "", t) for t in re.split(f"[{SPACES}]+", text.lower()))
    return [t for t in parts if t]


def tokens(text: Column, stop_words: bool = False) -> Column:
    """Lower-case tokens without outer marks; null for null."""
    out = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(out, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else out


def _quoted(q: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", q, flags=re.ASCII) if q.isascii() else "".join("\\" + c if c.isascii() and not (c.isalnum() or c == "_") else c for c in q)


def _has(low: Column, q: str) -> Column:
    """Does a token of the lower-case text begin with q? The plain searches first: they are cheap, and settle most texts. A text
    that has q only within words is ruled out by a pattern that begins with q, which is found faster than a place before it."""
    at = _quoted(q)
    return low.contains(q) & (low.contains(" " + q) | low.startswith(q) | (low.rlike(rf"{at}(?<!\w{at})") & low.rlike(BEFORE + at)))


def matches(text: Column, query: str) -> Column:
    """All tokens of the query are tokens of the text, or begin some. A blank query, or a null text, matches."""
    wanted = tokenize(query)
    if not wanted:
        return F.lit(True)
    low = F.lower(text)
    every = [low.contains(q) for q in dict.fromkeys(wanted)] + [_has(low, q) for q in dict.fromkeys(wanted)]
    return F.coalesce(reduce(Column.__and__, every), F.lit(True))


def matches_any(texts: list[Column], query: str) -> Column:
    """Each token of the query is found in one of the texts; null texts have none."""
    wanted = tokenize(query)
    if not wanted:
        return F.lit(True)
    if not texts:
        return F.lit(False)
    return reduce(Column.__and__, [reduce(Column.__or__, [F.coalesce(_has(F.lower(t), q), F.lit(False)) for t in texts]) for q in dict.fromkeys(wanted)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of the value, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def score(text: Column, query: str) -> Column:
    """coverage * (1 + frequency / length) / ln(1 + length): coverage is the share of query tokens found, frequency counts
    tokens that are equal to a query token as 1 and others that it begins as 0.5."""
    wanted = tokenize(query)
    if not wanted:
        return F.lit(0.0)

    def count(some: Column, fits: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(some, lambda t: fits(t))).cast("double")  # a lambda of one name, as filter gives places to a second

    def points(length: Column, some: Column) -> Column:
        hits, frequency = F.lit(0.0), F.lit(0.0)
        for q in wanted:
            exact, prefix = count(some, lambda t, q=q: t == q), count(some, lambda t, q=q: t.startswith(q))
            hits = hits + F.when(prefix > 0, 1.0).otherwise(0.0)
            frequency = frequency + exact + (prefix - exact) * 0.5
        return F.when(hits > 0, hits / float(len(wanted)) * (1.0 + frequency / length) / F.log1p(length))

    # the text is read once, its tokens once for all of the query; what is left is counted over the few that fit
    fits = lambda t: reduce(Column.__or__, [t.startswith(q) for q in dict.fromkeys(wanted)])
    found = _let(tokens(text), lambda every: F.struct(F.size(every).cast("double").alias("n"), F.filter(every, fits).alias("some")))
    return F.coalesce(_let(found, lambda x: points(x["n"], x["some"])), F.lit(0.0))


def token_table(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(token, id) of the fields, once each: an index to be written and looked up by token."""
    every = F.flatten(F.array(*[F.coalesce(tokens(F.col(f"`{f}`")), F.array().cast("array<string>")) for f in fields]))
    return df.select(F.col(id_col), F.explode(F.array_distinct(every)).alias("token"))


def eligible(condition: Mapping | None, indexed: Sequence[str]) -> tuple[str, list[str]] | None:
    """(query, fields) of a condition whose search an index over these fields can answer, or None: a search over some of the
    indexed fields, or on one of them, at the top of the condition."""
    if not condition or not indexed:
        return None
    asked = condition.get("$search")
    if isinstance(asked, Mapping):
        fields = list(asked.get("fields") or ())
        if fields and set(fields) <= set(indexed) and tokenize(asked.get("query", "")):
            return asked["query"], fields
    for f in indexed:
        x = condition.get(f)
        if isinstance(x, Mapping) and isinstance(x.get("$search"), str) and tokenize(x["$search"]):
            return x["$search"], [f]
    return None


def lookup(table: DataFrame, id_col: str, query: str) -> DataFrame:
    """Ids of rows that have all tokens of the query, by prefix; one sum over the few tokens that fit."""
    wanted = tokenize(query)
    fits = [F.col("token").startswith(q) for q in wanted]
    if not fits:
        return table.select(id_col).distinct()
    some = fits[0]
    for f in fits[1:]:
        some = some | f
    found = table.where(some).groupBy(id_col).agg(*[F.bool_or(f).alias(f"_{i}") for i, f in enumerate(fits)])
    return found.where(" and ".join(f"_{i}" for i in range(len(fits)))).select(id_col)

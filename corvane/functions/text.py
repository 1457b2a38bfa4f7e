"""String, token and keyword expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space that a strip takes off: every space but the non-breaking ones.
STRIPPED = "\t\n\v\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
SEPARATOR = "<SEP>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, as Unicode sees it."""
    return F.btrim(col(c), F.lit(STRIPPED))


def trim_controls(c: Column | str) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def normal_key(c: Column | str) -> Column:
    """The id of a name: stripped and lower-cased."""
    return F.lower(strip(c))


def token_count(c: Column | str) -> Column:
    """White-space separated tokens."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*[F.when(~blank(c), col(c)) for c in columns])


def clean_list(values: Column | str) -> Column:
    """Stripped, without blanks and repetitions, in order."""
    return F.array_distinct(F.filter(F.transform(col(values), strip), lambda x: x != ""))


def merged_lists(a: Column | str, b: Column | str) -> Column:
    return clean_list(F.concat(F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>"))))


def split_values(joined: Column | str, separator: str = SEPARATOR) -> Column:
    """Parts of a joined text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(joined), "\\Q" + separator + "\\E"), strip), lambda x: x != "")


def join_values(values: Column | str, separator: str = SEPARATOR) -> Column:
    return F.array_join(clean_list(values), separator)


def merged_csv(a: Column | str, b: Column | str) -> Column:
    """Comma-separated values of both, in order, once each."""
    both = F.concat_ws(",", F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit("")))
    return F.array_join(clean_list(F.split(both, ",")), ",")


def keyword_parts(c: Column | str) -> Column:
    """A keyword list's parts, each with runs of blanks, underscores and hyphens as one underscore."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.regexp_replace(strip(x), r"[\s_-]+", "_")), lambda x: x != "")


def canonical_keywords(c: Column | str) -> Column:
    """As a relation first gets them: lower-cased, sorted, once each."""
    return F.array_join(F.array_sort(F.array_distinct(keyword_parts(normal_key(c)))), ", ")


def merged_keywords(current: Column | str, incoming: Column | str) -> Column:
    """As a relation gets more: in order, once each, case as it is."""
    return F.array_join(F.array_distinct(F.concat(keyword_parts(F.coalesce(col(current), F.lit(""))), keyword_parts(F.coalesce(col(incoming), F.lit(""))))), ", ")


def relation_id(source: Column | str, target: Column | str) -> Column:
    """The id of an undirected relation, from its endpoints in canonical order."""
    a, b = col(source), col(target)
    return F.concat(F.lit("rel-"), F.md5(F.concat(F.least(a, b), F.greatest(a, b))))


def search_tokens(c: Column | str) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def lexical_match(query: Column | str, name: Column | str) -> Column:
    """1 if the query holds the name, else the share of the name's words that it holds."""
    q, n = normal_key(query), normal_key(name)
    words = F.filter(F.split(n, r"[^\p{IsAlphabetic}\p{IsDigit}\p{IsIdeographic}]+"), lambda x: x != "")
    share = F.size(F.filter(words, lambda w: F.contains(q, w))) / F.size(words)
    return F.when((F.coalesce(q, F.lit("")) == "") | (F.coalesce(n, F.lit("")) == ""), 0.0).when(F.contains(q, n), 1.0).when(F.size(words) == 0, 0.0).otherwise(share)


def fixed3(x: Column | str) -> Column:
    return F.format_string("%.3f", col(x))

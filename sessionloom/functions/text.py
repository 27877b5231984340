"""Scalar expressions over query strings, result lists and timestamps (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names that mark a query as structured when one stands before a colon.
SPECIAL_FIELDS = (
    "abstract", "acceptedDate", "arxivId", "authors", "citationCount", "contributors", "createdDate", "dataProviders",
    "depositedDate", "documentType", "doi", "downloadUrl", "fieldOfStudy", "fullText", "identifiers", "journals", "links",
    "magId", "oaiIds", "outputs", "publishedDate", "publisher", "pubmedId", "references", "sourceFulltextUrls", "title",
    "updatedDate", "yearPublished", "language", "_exists_", "id", "yearpublished", "updateddate",
)
# Patterns of structured queries.
STRUCTURED = r"(?i)yearPublished|(<=|>=|<|>)\s*\d|\bAND\s*\(|\bOR\s*\("
STRUCTURED_PAIR = r"(?i)year\s*:|yearpublished|(<=|>=|<|>)\s*\d|\bAND\s*\(|\bOR\s*\("
WHITE = r"(?U)\s+"


def norm(q: Column) -> Column:
    """Trimmed of all white space, in lower case."""
    return F.lower(F.regexp_replace(q, r"(?U)^\s+|\s+\z", ""))


def tokens(q: Column) -> Column:
    return F.filter(F.split(F.lower(q), WHITE), lambda w: w != "")


def squeeze(q: Column) -> Column:
    """In lower case, without white space, apostrophes, hyphens and full stops."""
    return F.regexp_replace(F.lower(q), r"(?U)[\s'\-.]", "")


def strip_url(q: Column) -> Column:
    out = norm(q)
    for part in (".com", "www.", "http_", "http://", "https://"):  # fixed values, in this order
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.trim(out)


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def within(small: Column, big: Column) -> Column:
    """Multiset containment of arrays."""
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    return F.forall(F.array_distinct(small), lambda w: times(small, w) <= times(big, w))


def sanitize(q: Column) -> Column:
    return F.trim(F.regexp_replace(q, "[^0-9a-zA-Z]+", " "))


def title_norm(t: Column) -> Column:
    """Lower case; every run of other characters than letters and digits becomes a space."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)[\W_]+", " "))


def title_norm_keep_underscore(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "), WHITE, " "))


def boolean_words(q: Column) -> Column:
    return F.size(F.regexp_extract_all(q, F.lit(r"(?U)\b(AND|OR|NOT)\b"), 0))


def token_count(q: Column) -> Column:
    """Words and punctuation marks, each its own token (an approximation of a treebank tokenizer)."""
    return F.size(F.regexp_extract_all(q, F.lit(r"(?U)\w+|[^\w\s]"), 0))


def serp_ids(serp: Column) -> Column:
    """Every run of digits as bigint; a run too long for one is dropped."""
    return F.filter(F.transform(F.regexp_extract_all(serp, F.lit(r"\d+"), 0), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def serp_ids_strict(serp: Column) -> Column:
    """Only the comma-separated parts that are all digits."""
    return F.transform(F.filter(F.transform(F.split(serp, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\z")), lambda x: x.try_cast("bigint"))


def serp_set(serp: Column) -> Column:
    inner = F.regexp_replace(F.trim(serp), r"^[\[\]]+|[\[\]]+\z", "")
    return F.array_distinct(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is null or empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def utc_day(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def to_epoch(s: Column) -> Column:
    """Seconds from seconds, milliseconds (above 1e12) or one of four date formats; else null."""
    number = s.try_cast("double")
    cut = F.substring(s, 1, 26)
    parsed = F.coalesce(*[F.try_to_timestamp(cut, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")])
    return F.coalesce(F.when(number > 1e12, F.floor(number / 1000)).otherwise(F.floor(number)), F.unix_seconds(parsed)).cast("bigint")


def from_german(s: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(s, F.lit("dd.MM.yyyy HH:mm:ss")))


def merge_key(track_id: Column) -> Column:
    return F.substring_index(track_id, "-", 1)


def length_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 50, "11-50").otherwise(">50")


def char_grams(q: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside each space-padded word; a padded word no longer than n gives one gram and no longer ones."""
    words = F.filter(F.split(F.regexp_replace(F.lower(q), WHITE, " "), " "), lambda w: w != "")

    def grams(w):
        size = F.length(w) + 2
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (size > n - 1))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, n))))

    return F.flatten(F.transform(words, grams))


def word_grams(q: Column, stop: list[str]) -> Column:
    """Words of two characters or more outside the stop list, and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"(?U)\b\w\w+\b"), 0), lambda w: ~w.isin(stop) if stop else F.lit(True))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def position_bucket(n: Column) -> Column:
    return F.when(n == 1, "1 (Singleton)").when(n == 2, "2").when(n == 3, "3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")


def time_text(ts: Column, seconds: bool = True) -> Column:
    """Epoch seconds as UTC text, to the second or to the minute."""
    text = F.date_format(F.timestamp_seconds(ts.cast("bigint")), "yyyy-MM-dd HH:mm:ss")
    return text if seconds else F.substring(text, 1, 16)

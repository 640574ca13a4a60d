"""Text functions as column expressions (no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.operators import graph

#: Longest clause in bytes, and most clauses of a document.
CLAUSE_BYTES, CLAUSES = 640, 256


def clauses(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, clause_idx, clause, truncated): trimmed pieces between . ! ? ; and line breaks.

    Of the first ``CLAUSES`` pieces those of more than ``CLAUSE_BYTES`` are left out; ``truncated`` tells of either.
    """
    pieces = F.filter(F.transform(F.split(F.col(text_col), r"[.!?;\n]"), lambda c: F.trim(c)), lambda c: c != "")
    first = df.select(id_col, pieces.alias("_p")).select(id_col, F.slice("_p", 1, CLAUSES).alias("_f"), (F.size("_p") > CLAUSES).alias("_more"))
    rows = first.select(id_col, F.filter("_f", lambda c: F.octet_length(c) <= CLAUSE_BYTES).alias("_c"), "_f", "_more")
    rows = rows.select(id_col, "_c", (F.col("_more") | (F.size("_c") < F.size("_f"))).alias("truncated"))
    return rows.select(id_col, F.posexplode("_c").alias("clause_idx", "clause"), "truncated")


def normal_text(c: Column) -> Column:
    """Lower case, with anything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def initials(c: Column) -> Column:
    """The upper-case first letters of the words."""
    words = F.filter(F.split(normal_text(c), " "), lambda w: w != "")
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def acronyms(c: Column) -> Column:
    """Tokens of 2 to 12 upper-case letters or digits that begin with a letter."""
    return F.filter(F.split(c, r"[\s,.;:!?()]+"), lambda w: w.rlike("^[A-Z][A-Z0-9]{1,11}$"))


# Words that mark how a clause is asserted.
HEDGES = r"\b(?:might|may|perhaps|possibly|apparently|seems to|appears to|is likely to)\b"
CONDITIONS = r"^(?:if|when|provided|assuming|even with|even if|even when)\b|\bcould\b"
COUNTERFACTUALS = r"^(?:were|had|imagine|counterfactually)\b|\b(?:would|were|had)\b"
NEGATIONS = r"^(?:not|do not|does not|we do not|cannot|never|no longer)\b|\b(?:is not|are not|must not|does not apply|do not apply|did not apply)\b| not (?:define|denote|represent|mean)\b"
CITATIONS = r"\bas reported\b|^according to\b"


def frame(c: Column) -> Column:
    """struct(conditionality, modality, polarity) of a clause, and whether it establishes facts."""
    low = F.lower(F.trim(c))
    conditionality = F.when(low.rlike(COUNTERFACTUALS), "counterfactual").when(low.rlike(CONDITIONS), "conditional").otherwise("unconditional")
    modality = F.when(conditionality != "unconditional", "hypothetical").when(low.rlike(HEDGES), "hedged").when(low.rlike(CITATIONS), "cited").otherwise("asserted")
    polarity = F.when(low.rlike(NEGATIONS), "negative").otherwise("positive")
    return F.struct(conditionality.alias("conditionality"), modality.alias("modality"), polarity.alias("polarity"), ((modality == "asserted") & (polarity == "positive")).alias("establishes"))


# Words for small numbers.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
_EXTENT = r"([0-9]+|[a-z]|one|two|three|four|five|six|seven|eight|nine|ten)"


def _extent(c: Column) -> Column:
    words = F.create_map(*(F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i + 1))))
    return F.coalesce(F.try_element_at(words, c), c)


def shape(c: Column) -> Column:
    """struct(kind, rows, columns) that a description states; null kind if none.  '?' stands for an unknown extent."""
    low = F.lower(F.trim(c))
    by = _EXTENT + r"\s*(?:by|x|×|\\times)\s*" + _EXTENT
    dim = _EXTENT + r"-(?:dimensional )?(?:[a-z]+ )*(?:vector|state|input|control)"
    has_by, has_dim = low.rlike(rf"\b{by}\b.*\bmatrix\b"), low.rlike(rf"\b{dim}\b")
    has_square = low.rlike(rf"\bsquare matrix of size {_EXTENT}\b")
    size = F.regexp_extract(low, rf"square matrix of size {_EXTENT}", 1)
    kind = F.when(has_by | has_square, "matrix").when(has_dim, "vector").when(low.rlike(r"\bmatrix$"), "matrix").when(low.rlike(r"\bvector$"), "vector").when(low.rlike(r"\bscalar\b"), "scalar").when(low.rlike(r"\btensor$"), "tensor")
    rows = F.when(has_by, _extent(F.regexp_extract(low, by, 1))).when(has_square, _extent(size)).when(has_dim, _extent(F.regexp_extract(low, dim, 1))).when(kind.isin("matrix", "vector", "tensor"), "?")
    columns = F.when(has_by, _extent(F.regexp_extract(low, by, 2))).when(has_square, _extent(size)).when(kind == "matrix", "?")
    return F.struct(kind.alias("kind"), rows.alias("rows"), columns.alias("columns"))


def include_path(base: Column, target: Column) -> Column:
    """A target path relative to a document's folder, with '.' and '..' resolved."""
    parts = F.split(F.concat_ws("/", F.regexp_replace(base, r"/?[^/]*$", ""), target), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).when(p == "..", a).otherwise(F.concat(a, F.array(p)))), "/")


def contained_terms(df: DataFrame, id_col: str, text: Column, terms: DataFrame, term_col: str) -> DataFrame:
    """(id, term): terms that occur as whole words; n-grams of as many words as the longest term has are exploded and joined by equality."""
    longest, n_terms = terms.agg(F.coalesce(F.max(F.size(F.split(term_col, " "))), F.lit(1)), F.count(term_col)).first()
    few = graph.broadcast_few(terms.select(term_col), n_terms)
    words = F.split(normal_text(text), " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return df.select(id_col, F.explode(F.array_distinct(grams)).alias(term_col)).join(few, term_col).select(id_col, term_col)

"""What is done to ranked hits before an answer: coverage of the query's terms, conflicting values, rerank, prompt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import token_estimate, tokens
from millrace.operators.retrieval import query_terms

#: A word and the number after it.
NAMED_VALUE = r"\p{L}+ [0-9]+(?:\.[0-9]+)?"


def coverage(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, slots, covered, coverage: a query's terms are its slots, covered if a hit (query_id, text) has the term.

    A query without terms has no row; one without hits covers nothing. Only texts that were hit are split up.
    """
    terms = query_terms(queries, stop=True)
    have = found.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    marked = terms.join(have.withColumn("hit", F.lit(1)), ["query_id", "term"], "left")
    counted = marked.groupBy("query_id").agg(F.count("*").alias("slots"), F.count("hit").alias("covered"))
    return counted.withColumn("coverage", F.round(F.col("covered") / F.col("slots"), 6))


def refuses(share: Column, high_conflict: Column, threshold: float) -> Column:
    """Never at a threshold of 0 or less; else on a high conflict or a coverage below the threshold."""
    if threshold <= 0:
        return F.lit(False)
    return high_conflict | (share < threshold)


def named_values(docs: DataFrame, group: str = "kb_id") -> DataFrame:
    """group, doc_id, section (a line's place), name (lower case) and value of each word followed by a number."""
    lines = docs.select(group, "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("section", "line"))
    found = F.regexp_extract_all("line", F.lit(f"({NAMED_VALUE})"), 1)
    one = lines.select(group, "doc_id", "section", F.explode(found).alias("pair"))
    parts = F.split("pair", " ")
    return one.select(group, "doc_id", "section", F.lower(parts[0]).alias("name"), parts[1].alias("value"))


def conflicts(values: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several values: how many, in how many documents and sections, kind and severity.

    Several documents, or a single section, are a value mismatch and high; several sections of one document are a
    section mismatch and medium.
    """
    counted = values.groupBy(*keys).agg(
        F.count_distinct("value").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("doc_id", "section").alias("n_sections")
    )
    medium = (F.col("n_docs") == 1) & (F.col("n_sections") > 1)
    return counted.where("n_values > 1").select(
        *keys, "n_values", "n_docs", F.when(medium, "section_mismatch").otherwise("value_mismatch").alias("kind"),
        F.when(medium, "medium").otherwise("high").alias("severity"),
    )


def rerank(hits: DataFrame, relevance: DataFrame, least_range: float = 0.001) -> DataFrame:
    """``hits`` (query_id, doc_id, score, rank) with place, by a reranker's answers (query_id, doc_id, relevance).

    Answered hits come first by relevance, the others in their order. Where a query's answers differ by
    ``least_range`` or less, or there are none, the search's own order stays.
    """
    joined = hits.join(relevance.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    whole = Window.partitionBy("query_id")
    told = F.coalesce(F.max("relevance").over(whole) - F.min("relevance").over(whole), F.lit(0.0)) > least_range
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("by"), "rank")
    return joined.withColumn("by", F.when(told, F.col("relevance"))).withColumn("place", F.row_number().over(order)).drop("by")


def prompt_budget(ranked: DataFrame, budget: int, label: int = 20) -> DataFrame:
    """The longest run of first hits (query_id, doc_id, text, rank) whose tokens, with ``label`` for each, fit the
    budget, with the characters kept. A first hit that does not fit alone is cut; a budget of 0 keeps nothing."""
    cost = token_estimate(F.col("text")) + label
    used = F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank"))
    most = max(0, int(budget * 1.5) - 20)
    n = F.length(F.coalesce("text", F.lit("")))
    chars = F.when(F.col("used") <= budget, n).otherwise(F.least(n, F.lit(most)))
    kept = ranked.withColumn("used", used).where((F.col("used") <= budget) | ((F.col("rank") == 1) & F.lit(budget > 0 and most > 0)))
    return kept.select("query_id", "doc_id", "rank", chars.alias("chars"))

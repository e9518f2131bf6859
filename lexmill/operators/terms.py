"""Many terms in many texts: one automaton for all terms, one pass over the texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Characters of all terms together, which bound the automaton that every task gets (some 50 bytes each).
MOST_CHARS = 4 << 20


def _listed(terms: DataFrame, *columns: str) -> list[tuple]:
    """The distinct rows of a declared list of terms, whose size is checked before they are collected."""
    rows = terms.select(*columns).where(F.col(columns[-1]).isNotNull()).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.char_length(columns[-1])), F.lit(0))).first()[0]
    if chars > MOST_CHARS:
        raise ValueError(f"terms have {chars} characters, more than {MOST_CHARS}")
    return sorted(map(tuple, rows.collect()))


def _automaton(terms) -> ahocorasick.Automaton | None:
    """Finds the numbers of all terms that occur; None without terms."""
    out = ahocorasick.Automaton()
    for term, number in terms:
        if term:
            out.add_word(term, number)
    if not len(out):
        return None
    out.make_automaton()
    return out


def found_terms(pages: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """term: those of ``terms`` that stand anywhere in the texts, compared in lower case. A blank term stands in every text.

    A task names each term once, and stops looking when all are found."""
    listed = _listed(terms.select(F.lower(term).alias(term)), term)
    shared = pages.sparkSession.sparkContext.broadcast(listed)

    def scan(batches):
        words = [t for (t,) in shared.value]
        search, left = _automaton([(t, i) for i, t in enumerate(words)]), set(range(len(words)))
        blank = {i for i, t in enumerate(words) if not t}
        for batch in batches:
            hits = set()
            for value in batch.column(0).to_pylist():
                if value is None or not left:
                    continue
                found = blank | ({n for _, n in search.iter(value)} if search else set())
                hits |= found & left
                left -= found
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in sorted(hits)], pa.string())], names=["term"])

    return pages.select(F.lower(text).alias("t")).mapInArrow(scan, "term string").distinct()


def absent_terms(terms: DataFrame, key: str, pages: DataFrame, text: str) -> DataFrame:
    """key, absent: whether no text holds the key's term (``term``), compared in lower case; a null term is absent."""
    found = found_terms(pages, text, terms).withColumn("__hit", F.lit(True))
    rows = terms.withColumn("__low", F.lower("term"))
    return rows.join(found.withColumnRenamed("term", "__low"), "__low", "left").select(key, F.col("__hit").isNull().alias("absent"))


def category_votes(rows: DataFrame, key: str, text: str, terms: DataFrame, pending: str = "pending") -> DataFrame:
    """key, category: the category (of ``terms``: category, term) most of whose terms occur in the text, case folded;
    ties to the first by name, ``pending`` without a hit. Terms of any number cost one pass over each text."""
    folded = terms.select("category", T.casefold("term").alias("term"))
    shared = rows.sparkSession.sparkContext.broadcast(_listed(folded, "category", "term"))
    kind = rows.schema[key].dataType.simpleString()

    def vote(batches):
        of: dict[str, list[str]] = {}
        for category, term in shared.value:
            of.setdefault(term, []).append(category)
        words = sorted(of)
        search, blank = _automaton([(t, i) for i, t in enumerate(words)]), [i for i, t in enumerate(words) if not t]
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                votes: dict[str, int] = {}
                if value is not None:
                    for i in {n for _, n in search.iter(value)}.union(blank) if search else blank:
                        for category in of[words[i]]:
                            votes[category] = votes.get(category, 0) + 1
                out.append(min(votes, key=lambda c: (-votes[c], c)) if votes else pending)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["k", "category"])

    return rows.select(F.col(key).alias("k"), T.casefold(text).alias("t")).mapInArrow(vote, f"k {kind}, category string").withColumnRenamed("k", key)

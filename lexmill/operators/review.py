"""Records under review: topic identities, questions and answers, entries, scores, releases.

Checks give code rows or code columns instead of raising, so that one bad record does not hide
the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract.
ACCEPTED_ENTRIES = ("not_released", "passed", "verified", "verified_source_precheck", "reconciled_for_task2a_entry")
QUALITY_POINTS = {"structure": 20.0, "source_coverage": 20.0, "product_entry": 15.0, "reader_cleanliness": 15.0, "content_fidelity": 20.0, "traceability": 10.0}
NO_HIT = {"answer_found": False, "first_hit_page": None, "source_attribution": False, "answer_result": "no_match", "source_recheck_result": "not_applicable"}


def resolve_topics(topics: DataFrame, lock: DataFrame) -> DataFrame:
    """topic_id, source_ids, category_id, published_path, state, needs_review.

    ``topics`` (topic_id, source_ids, category_id, published_path as wished) and ``lock`` (the same columns,
    one row per topic). A locked topic keeps its category and path, adds its sources to the locked ones, and is
    to be reviewed if it now has another category. A new one gets the path that it wishes, or, where a
    locked or an earlier new topic (by topic_id) has it, that path with the first 8 characters
    of its id, and is to be reviewed. Null sources count as none; a null
    wish stays null and collides with nothing."""
    held = lock.select("topic_id", F.col("source_ids").alias("__s"), F.col("category_id").alias("__c"), F.col("published_path").alias("__p"))
    used = lock.select("published_path").distinct().withColumn("__used", F.lit(True))
    rows = topics.join(held, "topic_id", "left").join(used, "published_path", "left")
    new = F.col("__p").isNull()
    # the first new topic of each wished path, by an aggregate: many topics may wish the same
    first = topics.join(held.select("topic_id"), "topic_id", "left_anti").groupBy("published_path").agg(F.min("topic_id").alias("__first"))
    rows = rows.join(first, "published_path", "left")
    taken = new & (F.coalesce("__used", F.lit(False)) | F.coalesce(F.col("__first") != F.col("topic_id"), F.lit(False)))
    own = F.concat(F.regexp_replace("published_path", r"\.md$", ""), F.lit("-"), F.substring(F.regexp_replace("topic_id", "^topic-", ""), 1, 8), F.lit(".md"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("source_ids", none), F.coalesce("__s", none))
    return rows.select(
        "topic_id",
        F.array_sort(F.filter(both, lambda x: x.isNotNull() & (x != ""))).alias("source_ids"),
        F.coalesce("__c", "category_id").alias("category_id"),
        F.coalesce("__p", F.when(taken, own).otherwise(F.col("published_path"))).alias("published_path"),
        F.when(new, "new").otherwise("kept").alias("state"),
        F.when(new, taken).otherwise(~F.col("__c").eqNullSafe(F.col("category_id"))).alias("needs_review"),
    )


def answerability_failures(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, code: ``answers`` (question_id, polarity, answerable, first_hit) that break the contract with
    ``questions`` (question_id, polarity): each question once and no other, with its polarity; a first
    hit exactly where it is answerable; no negative one answerable. No rows: it holds."""
    a = answers.groupBy("question_id").agg(F.count("*").alias("n"), F.first("polarity").alias("p"), F.first("answerable").alias("ok"), F.first("first_hit").alias("hit"))
    q = questions.select("question_id", F.col("polarity").alias("want")).dropDuplicates(["question_id"]).withColumn("known", F.lit(True))
    j = a.join(q, "question_id", "full_outer")
    hit = F.trim(F.coalesce("hit", F.lit(""))) != ""
    single = (F.col("n") == 1) & F.col("known")
    codes = F.array(
        F.when(F.col("n").isNull(), "ANSWER_MISSING"),
        F.when(F.col("known").isNull(), "QUESTION_UNKNOWN"),
        F.when(F.col("n") > 1, "ANSWER_REPEATED"),
        F.when(single & (F.col("ok").isNull() | ~F.col("p").eqNullSafe(F.col("want"))), "POLARITY_OR_STATUS"),
        F.when(single & F.col("ok") & ~hit, "FIRST_HIT_MISSING"),
        F.when(single & ~F.col("ok") & F.col("hit").isNotNull(), "FIRST_HIT_UNEXPECTED"),
        F.when(single & F.col("ok") & (F.col("want") == "negative"), "NEGATIVE_ANSWERABLE"),
    )
    return j.select("question_id", F.explode(F.array_compact(codes)).alias("code"))


def normalize_verdict(rows: DataFrame, page: str, oracle: str, bounded: Column) -> DataFrame:
    """``rows`` with the response fields as the structural oracle ('passed', 'failed', 'not_applicable') has
    them, and failure_reason: a response that is not ``bounded`` is no match whatever it says, a passed
    oracle is a complete hit on the target page, a failed one no match, and otherwise the response stays."""
    free, wild = F.col(oracle) == "not_applicable", ~F.coalesce(bounded, F.lit(False))
    hit = {"answer_found": F.lit(True), "first_hit_page": F.col(page), "answer_complete": F.lit(True), "boundary_version_accurate": F.lit(True), "source_attribution": F.lit(True), "answer_result": F.lit("hit"), "source_recheck_result": F.lit("passed")}
    out = {}
    for name, value in hit.items():
        kept = F.col(name)
        failed = F.lit(NO_HIT[name]) if name in NO_HIT else kept
        out[name] = F.when(free, kept).when(wild, F.lit(NO_HIT.get(name, False))).when(F.col(oracle) == "passed", value).otherwise(failed)
    return rows.withColumns(out | {"failure_reason": F.when(~free & wild, "provider_response_contract_invalid")})


def score(rows: DataFrame, passed: str, sample_size: str, stated: list[str], minimum: float = 0.9) -> DataFrame:
    """``rows`` with rate and code: METADATA_INVALID (rate 0) if counts are null or do not fit each other, or any
    stated field is blank; ACCURACY_BELOW_THRESHOLD if the rate is below the minimum; else null."""
    sound = (F.col(sample_size) > 0) & F.col(passed).between(0, F.col(sample_size))
    for c in stated:
        sound = sound & (F.trim(c) != "")
    sound = F.coalesce(sound, F.lit(False))
    rate = F.when(sound, F.col(passed) / F.col(sample_size)).otherwise(0.0)
    return rows.withColumn("rate", rate).withColumn("code", F.when(~sound, "METADATA_INVALID").when(F.col("rate") < minimum, "ACCURACY_BELOW_THRESHOLD"))


def entry_bindings(entries: DataFrame, bundle: str, process: str, status: str) -> DataFrame:
    """``entries`` with codes (sorted, comma-joined; '' if none) and binding ('passed' or 'blocked').

    An entry needs an accepted status and a producing process, which all accepted entries of a bundle
    share; entries of other status are not asked for one, but are blocked with the rest if processes
    differ. An entry without a bundle stands alone."""
    fit = F.coalesce(F.col(status).isin(*ACCEPTED_ENTRIES), F.lit(False))
    named = F.when(fit & (F.trim(process) != ""), F.col(process))
    # two aggregates that combine on the map side, not a set of all processes
    of = entries.groupBy(bundle).agg((F.min(named) != F.max(named)).alias("__mixed"))
    j = entries.join(of, bundle, "left")
    codes = F.array(F.when(F.coalesce("__mixed", F.lit(False)), "ENTRY_PRODUCER_MISMATCH"), F.when(fit & named.isNull(), "ENTRY_PRODUCER_MISSING"), F.when(~fit, "ENTRY_STATUS_UNSUPPORTED"))
    out = F.array_join(F.array_compact(codes), ",")
    return j.withColumn("codes", out).withColumn("binding", F.when(F.col("codes") == "", "passed").otherwise("blocked")).drop("__mixed")


def quality_proxy(documents: DataFrame, *, product: str, module: str, valid: str, readable: str, anchored: str, entry: str, violations: str) -> DataFrame:
    """One row: the six components and their sum (at most 100, 2 decimals).

    Structure needs a product and a module; coverage is valid sources of all; product entries are products of
    which a document is an ``entry``; each violation costs one point of cleanliness; fidelity
    is valid ones of the readable; traceability anchored ones of the valid. No documents: no points but for cleanliness."""
    p = QUALITY_POINTS
    products = documents.groupBy(product).agg(
        F.count("*").alias("n"), F.count_if(valid).alias("v"), F.count_if(readable).alias("r"), F.count_if(F.col(valid) & F.col(anchored)).alias("a"),
        F.bool_or(entry).alias("e"), F.coalesce(F.sum(violations), F.lit(0)).alias("x"), F.count(module).alias("m"),
    )
    t = products.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "nvraxm"], F.count_if("e").alias("e"), F.count(product).alias("p"))
    share = lambda a, b, points: F.when(F.col(b) > 0, points * F.col(a) / F.col(b)).otherwise(0.0)
    parts = {
        "structure": F.when((F.col("p") > 0) & (F.col("m") > 0), p["structure"]).otherwise(0.0),
        "source_coverage": share("v", "n", p["source_coverage"]),
        "product_entry": share("e", "p", p["product_entry"]),
        "reader_cleanliness": F.greatest(F.lit(0.0), p["reader_cleanliness"] - F.col("x")),
        "content_fidelity": share("v", "r", p["content_fidelity"]),
        "traceability": F.least(F.lit(p["traceability"]), share("a", "v", p["traceability"])),
    }
    total = F.lit(0.0)
    for x in parts.values():
        total = total + x
    return t.select(*[F.round(x, 2).alias(k) for k, x in parts.items()], F.least(F.lit(100.0), F.round(total, 2)).alias("score"))


def confirmation_valid(said: dict[str, str], run_id: str, summary: str, now: Column) -> Column:
    """Whether a confirmation's columns (meaning, actor, confirmed_at as text with a zone, run_id,
    summary_sha256) confirm this summary of this run: by a person, within 24 hours before ``now``."""
    when = F.try_to_timestamp(said["confirmed_at"])
    zoned = F.col(said["confirmed_at"]).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    same = (F.col(said["run_id"]) == F.col(run_id)) & (F.col(said["summary_sha256"]) == F.col(summary)) & F.col(summary).rlike("^[0-9a-f]{64}$")
    who = F.col(said["actor"]).startswith("human:") & (F.col(said["meaning"]) == "automatic-summary-confirmation")
    return F.coalesce(same & who & zoned & when.between(now - F.expr("INTERVAL 24 HOURS"), now), F.lit(False))


def question_pages(questions: list[tuple[str, str | None, str | None]], pages: DataFrame, most: int = 1_000) -> dict[str, str]:
    """question_id -> path of the page that it is asked on.

    ``questions`` (id, topic or null, page type or null), in order, a declared list of at most ``most``; ``pages``
    (path, topic_id, page_type, sampled). Candidates are the pages of the topic if it has one, else of the page
    type, else all; of them the first sampled path that no earlier question took, else the first path at all.
    A question takes at most one page, so as many first sampled paths of each group of candidates as there are questions decide."""
    if len(questions) > most:
        raise ValueError(f"more than {most} questions")
    if len({q for q, _, _ in questions}) < len(questions):
        raise ValueError("a question is there twice")
    kinds = sorted({("topic_id", t) if t is not None else ("page_type", p) if p is not None else ("all", "") for _, t, p in questions})
    of = {k: F.array(*[F.lit(v) for kind, v in kinds if kind == k]) if any(kind == k for kind, _ in kinds) else F.array().cast("array<string>") for k in ("topic_id", "page_type", "all")}
    groups = F.array(
        *[F.when(F.array_contains(of[c], F.col(c)), F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"))) for c in ("topic_id", "page_type")],
        F.when(F.lit(("all", "") in kinds), F.struct(F.lit("all").alias("kind"), F.lit("").alias("value"))),
    )
    each = pages.select("path", F.coalesce("sampled", F.lit(False)).alias("sampled"), F.explode(F.array_compact(groups)).alias("g")).select("path", "sampled", "g.*").distinct()
    rank = F.row_number().over(Window.partitionBy("kind", "value", "sampled").orderBy("path"))  # a limit by rank keeps the first rows of each task
    kept = each.withColumn("n", rank).where(F.col("n") <= len(questions)).collect()
    sampled, first, used, out = {}, {}, set(), {}
    for r in sorted(kept, key=lambda r: r["path"]):
        g = (r["kind"], r["value"])
        first.setdefault(g, r["path"])
        if r["sampled"]:
            sampled.setdefault(g, []).append(r["path"])
    everywhere = {p for paths in sampled.values() for p in paths}
    for q, t, p in questions:
        g = ("topic_id", t) if t is not None else ("page_type", p) if p is not None else ("all", "")
        if g not in first:
            raise ValueError(f"no page fits question {q}")
        out[q] = next((x for x in sampled.get(g, ()) if x not in used), first[g])
        if out[q] in everywhere:
            used.add(out[q])
    return out

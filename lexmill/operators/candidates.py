"""Generated candidates against their sources, two-layer pages, reused sections, and the index of sources behind pages.

Claims stay rows: multisets are compared by counting, and nothing but a draft's verdict is gathered per draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.contracts import CLAIM, STATE, STRINGS

# Fixed values of the contract: states of claims that no page shows, and of checks that a claim passed.
GONE, PENDING, PASSED = ("removed", "superseded"), "pending_review", ("passed", "verified", "ok")
LAYERS = ("usage", "rules")
HIDDEN = ("audit", "raw", "provider")


def candidate_gate(drafts: DataFrame, sources: DataFrame, candidates: DataFrame, coverage: DataFrame, structure: DataFrame) -> DataFrame:
    """draft, valid, reason, coverage_ratio, retained_ratio, n_missing of every candidate; the first broken rule is the reason.

    ``drafts``: draft, body, invalid_reason (null: not marked invalid). ``sources`` and ``candidates``: draft, source_uri, text, fingerprint, raw_id,
    locator, one row for each claim. ``coverage``: draft, raw_id, locator, page. ``structure``: draft, line. In order: ``marked_invalid``,
    ``lineage_missing`` (no URI or text), ``fingerprint_differs`` (from the claim's own URI and text), ``not_in_source``, ``lineage_differs`` (no
    source claim of that fingerprint stands there), ``claim_dropped`` (fewer than the source has, repeats counted),
    ``coverage_incomplete``, ``not_faithful`` (a claim's text is not in the body), ``structure_dropped``. A draft without claims covers
    all of them. Fingerprints and places meet by equality; a claim that a source repeats is a number."""
    print_of = T.claim_fingerprint("source_uri", "text")
    own = candidates.withColumn("unlinked", F.col("source_uri").isNull() | F.col("text").isNull()).withColumn("forged", F.coalesce(print_of != F.col("fingerprint"), F.col("fingerprint").isNull()))
    have = sources.groupBy("draft", "fingerprint").agg(F.count("*").alias("due"))
    places = sources.select("draft", "fingerprint", "raw_id", "locator", F.lit(True).alias("placed")).distinct()
    covered = coverage.where(F.coalesce(F.col("page"), F.lit("")) != "").select("draft", "raw_id", "locator", F.lit(True).alias("covered")).distinct()
    body = drafts.select("draft", T.normalize_for_gate("body").alias("plain"))
    seen = own.join(have, ["draft", "fingerprint"], "left").join(places, ["draft", "fingerprint", "raw_id", "locator"], "left").join(covered, ["draft", "raw_id", "locator"], "left").join(body, "draft")
    each = seen.groupBy("draft").agg(
        F.count("*").alias("n"), F.bool_or("unlinked").alias("unlinked"), F.bool_or("forged").alias("forged"), F.bool_or(F.col("due").isNull()).alias("foreign"), F.bool_or(F.col("placed").isNull()).alias("misplaced"),
        F.bool_or(~F.contains("plain", T.normalize_for_gate("text"))).alias("unfaithful"),
    )
    spots = seen.groupBy("draft", "raw_id", "locator").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("c")).groupBy("draft").agg(F.count("*").alias("spots"), F.count_if("c").alias("held"))
    given = candidates.groupBy("draft", "fingerprint").agg(F.count("*").alias("given"))
    lost = have.join(given, ["draft", "fingerprint"], "left").groupBy("draft").agg(F.sum(F.greatest(F.col("due") - F.coalesce("given", F.lit(0)), F.lit(0))).alias("n_missing"), F.sum("due").alias("eligible"))
    lines = drafts.select("draft", F.explode(T.lines("body")).alias("line")).select("draft", T.strip("line").alias("line")).where("line <> ''").groupBy("draft", "line").agg(F.count("*").alias("shown"))
    bare = structure.groupBy("draft", "line").agg(F.count("*").alias("due")).join(lines, ["draft", "line"], "left").where(F.coalesce("shown", F.lit(0)) < F.col("due")).select("draft", F.lit(True).alias("bare")).distinct()
    rows = drafts.select("draft", "invalid_reason").join(each, "draft", "left").join(spots, "draft", "left").join(lost, "draft", "left").join(bare, "draft", "left")
    n, missing, eligible = (F.coalesce(c, F.lit(0)) for c in ("n", "n_missing", "eligible"))
    ratio = F.coalesce(F.try_divide("held", "spots"), F.lit(1.0))
    on = lambda c: F.coalesce(c, F.lit(False))
    steps = (
        (F.col("invalid_reason").isNotNull(), "marked_invalid"), (on("unlinked"), "lineage_missing"), (on("forged"), "fingerprint_differs"), (on("foreign"), "not_in_source"), (on("misplaced"), "lineage_differs"),
        (missing > 0, "claim_dropped"), (ratio < 1, "coverage_incomplete"), (on("unfaithful"), "not_faithful"), (on("bare"), "structure_dropped"),
    )
    reason = F.lit(None).cast("string")
    for fails, name in reversed(steps):
        reason = F.when(fails, name).otherwise(reason)
    rows = rows.select("draft", reason.alias("reason"), ratio.alias("ratio"), F.when(eligible > 0, n / eligible).otherwise(1.0).alias("kept"), missing.alias("missing"))
    late = F.coalesce(F.col("reason").isin("coverage_incomplete", "not_faithful", "structure_dropped"), F.lit(False))
    passed = F.col("reason").isNull()
    return rows.select("draft", passed.alias("valid"), "reason", F.when(passed | late, F.col("ratio")).otherwise(0.0).alias("coverage_ratio"), F.when(passed, F.col("kept")).otherwise(0.0).alias("retained_ratio"), F.when(F.col("reason") == "claim_dropped", F.col("missing")).otherwise(0).cast("long").alias("n_missing"))


# --- two-layer pages --------------------------------------------------------


def two_layer_codes(pages: DataFrame, sections: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, code, detail of pages that break the two-layer shape.

    ``pages``: page_id, title, path. ``sections``: page_id, layer (usage or rules), section, claim_ids, bullets. ``claims``: page_id, claim_id. ``links``: page_id,
    kind (related or source), href. Every claim of a page's catalogue is owned by one section and once, and every bullet says one
    claim. Ownership is counted over rows, so that a claim without an owner and one with two show in the same pass."""
    own = sections.select("page_id", "section", F.explode("claim_ids").alias("claim_id"))
    owners = own.groupBy("page_id", "claim_id").agg(F.count("*").alias("owners"))
    catalogue = claims.groupBy("page_id", "claim_id").agg(F.count("*").alias("listed"))
    blank = F.coalesce(F.trim("claim_id"), F.lit("")) == ""
    both = catalogue.join(owners, ["page_id", "claim_id"], "full_outer")
    code = lambda fits, name: F.when(fits, name)
    of_claims = both.select("page_id", F.col("claim_id").alias("detail"), F.array_compact(F.array(
        code((F.col("listed") > 1) | (F.col("listed").isNotNull() & blank), "CATALOGUE_IDS"), code(F.col("listed").isNull(), "CLAIM_UNKNOWN"), code(F.col("owners").isNull() & ~blank, "CLAIM_UNOWNED"), code(F.col("listed").isNotNull() & (F.col("owners") > 1), "CLAIM_OWNED_TWICE"),
    )).alias("codes"))
    name = F.coalesce("section", F.lit(""))
    n_claims, n_bullets = F.coalesce(F.size("claim_ids"), F.lit(0)), F.coalesce(F.size("bullets"), F.lit(0))
    n_claims, n_bullets = F.when(F.col("claim_ids").isNull(), 0).otherwise(n_claims), F.when(F.col("bullets").isNull(), 0).otherwise(n_bullets)
    empty = F.coalesce(F.exists("bullets", lambda b: b.isNull() | (F.trim(b) == "")), F.lit(False))
    of_sections = sections.select("page_id", name.alias("detail"), F.array_compact(F.array(code(n_claims == 0, "SECTION_WITHOUT_CLAIMS"), code((n_claims > 0) & ((n_claims != n_bullets) | empty), "CONTENT_UNALIGNED"))).alias("codes"))
    names = sections.groupBy("page_id", name.alias("detail")).agg(F.count("*").alias("n")).select("page_id", "detail", F.array_compact(F.array(code((F.col("n") > 1) | (F.col("detail") == ""), "SECTION_IDS"))).alias("codes"))
    layers = sections.groupBy("page_id").agg(F.collect_set("layer").alias("l"))
    lacks = F.size(F.array_intersect(F.coalesce("l", F.array().cast(STRINGS)), F.array(*map(F.lit, LAYERS)))) < 2
    path = F.coalesce("path", F.lit(""))
    of_pages = pages.join(layers, "page_id", "left").select("page_id", F.lit(None).cast("string").alias("detail"), F.array_compact(F.array(
        code((F.coalesce(F.trim("title"), F.lit("")) == "") | (path == ""), "IDENTITY_MISSING"), code(path.rlike(r"cluster-|draft-|\.\."), "PATH_UNSTABLE"), code(lacks, "LAYER_MISSING"),
    )).alias("codes"))
    href = F.coalesce("href", F.lit(""))
    related = F.col("kind") == "related"
    hidden = F.lower(href).rlike("|".join(HIDDEN))
    outside = (href == "") | href.startswith("/") | (related & ~F.contains(href, F.lit("..")))
    of_links = links.select("page_id", href.alias("detail"), F.array_compact(F.array(code(outside, "LINK_NOT_LOCAL"), code(~outside & F.when(related, hidden).otherwise(F.lower(href).rlike("audit|raw")), "LINK_HIDDEN"))).alias("codes"))
    parts = [x.select("page_id", "detail", F.explode("codes").alias("code")) for x in (of_pages, of_claims, of_sections, names, of_links)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("page_id", "code", "detail").distinct()


# --- sections that stay, and what the gate is asked -------------------------


def reuse_sections(sections: DataFrame, old: DataFrame, reused: DataFrame) -> DataFrame:
    """``sections`` (page_id, section, body, claim_ids, status) with the old body and claims where ``reused`` (page_id, section) names a section
    whose old record (``old``: page_id, section, body, claim_ids) has a body; old claims count only if there are any."""
    before = old.select("page_id", "section", F.col("body").alias("__b"), F.filter("claim_ids", lambda c: F.trim(c) != "").alias("__c"), F.size("claim_ids").alias("__n"))
    marked = reused.select("page_id", "section").distinct().withColumn("__kept", F.lit(True))
    rows = sections.join(marked, ["page_id", "section"], "left").join(before, ["page_id", "section"], "left")
    keep = F.col("__kept").isNotNull() & (F.trim(F.coalesce("__b", F.lit(""))) != "")
    return rows.select("page_id", "section", F.when(keep, F.col("__b")).otherwise(F.col("body")).alias("body"), F.when(keep & (F.coalesce("__n", F.lit(0)) > 0), F.col("__c")).otherwise(F.col("claim_ids")).alias("claim_ids"), "status")


def gate_payloads(sections: DataFrame, claims: DataFrame, fragments: DataFrame, drafts: DataFrame) -> DataFrame:
    """What ``body_gate`` is asked about each of ``drafts`` (page_id, page_type): body, evidence, claims, ids and section states.

    ``sections``: page_id, place, section, body, claim_ids, status. ``claims``: page_id, place, claim_id, text, source_uri, locator, content_hash, fingerprint; of claims
    with one id the first by place stands for all. ``fragments``: page_id, place, text. The body is each section under its heading,
    with a footnote mark for every claim that its text does not mark, then the footnotes by claim id."""
    first = claims.groupBy("page_id", "claim_id").agg(F.min_by(F.struct("text", "source_uri", "locator", "content_hash", "fingerprint"), "place").alias("c"))
    cited = sections.select("page_id", "place", F.posexplode("claim_ids").alias("at", "claim_id")).join(first, ["page_id", "claim_id"])
    marks = cited.groupBy("page_id", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "claim_id"))), lambda x: x["claim_id"]).alias("ids"))
    body = T.strip(F.coalesce("body", F.lit("")))
    rows = sections.join(marks, ["page_id", "place"], "left").withColumn("text", body).withColumn("ids", F.coalesce("ids", F.array().cast(STRINGS)))
    mark = lambda c: F.concat(F.lit("[^"), c, F.lit("]"))
    # a mark that stands in the text is not set again; one that is set twice stands twice
    missing = F.transform(F.filter("ids", lambda c: ~F.contains("text", mark(c))), mark)
    lines = F.concat(F.array(F.concat(F.lit("## "), F.col("section"))), F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast(STRINGS)), missing)
    state = F.struct(
        F.col("section").alias("section"), F.lit(None).cast("string").alias("page_type"), F.coalesce("status", F.lit("documented")).alias("status"), F.col("text").alias("body"), F.coalesce("claim_ids", F.array().cast(STRINGS)).alias("claim_ids"),
        F.lit(None).cast("boolean").alias("audited"), F.lit(None).cast("boolean").alias("bound"), F.lit(None).cast("string").alias("question_status"),
    )
    gathered = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("place", lines.alias("lines"), state.alias("state")))).alias("s"))
    used = cited.select("page_id", "claim_id", "c").distinct().groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "c"))).alias("u"))
    evidence = fragments.where(F.coalesce("text", F.lit("")) != "").groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    out = drafts.select("page_id", "page_type").join(gathered, "page_id", "left").join(used, "page_id", "left").join(evidence, "page_id", "left")
    u = F.coalesce("u", F.array().cast(out.schema["u"].dataType))
    notes = F.transform(u, lambda x: F.concat(F.lit("[^"), x["claim_id"], F.lit("]: "), F.coalesce(x["c"]["source_uri"], F.lit("")), F.lit("#"), F.coalesce(x["c"]["locator"], F.lit(""))))
    text = F.array_join(F.concat(F.flatten(F.transform(F.coalesce("s", F.array().cast(out.schema["s"].dataType)), lambda x: x["lines"])), notes), "\n")
    fields: Column = F.transform(u, lambda x: F.struct(x["claim_id"].alias("claim_id"), x["c"]["text"].alias("text"), x["c"]["source_uri"].alias("source_uri"), x["c"]["locator"].alias("locator"), x["c"]["content_hash"].alias("content_hash"), x["c"]["fingerprint"].alias("fingerprint")))
    states = F.transform("s", lambda x: x["state"].withField("page_type", F.col("page_type")))
    return out.select(
        "page_id", T.strip(text).alias("body"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.lit(None).cast("string").alias("provider_status"), fields.cast(CLAIM).alias("claims"), F.transform(u, lambda x: x["claim_id"]).alias("typed_claim_ids"),
        states.cast(STATE).alias("states"), F.lit(None).cast(STRINGS).alias("others"), F.lit(None).cast(STRINGS).alias("exempt"),
    )


# --- sources behind pages ---------------------------------------------------


def source_index(snapshots: DataFrame, duplicates: DataFrame, pages: DataFrame, history: DataFrame) -> DataFrame:
    """source_uri, content_hash, status (``duplicate``, ``needs-review`` or ``published``), targets (sorted) of every source that a page shows or
    that somebody has to look at.

    ``snapshots``: source_uri, content_hash, seq (the last one counts). ``duplicates``: source_uri, canonical_uri, seq (the same). ``pages``: source_uri,
    target, degraded: this run's. ``history``: source_uri, target, verification_status, validation_status, provider_failed: the folded
    ledger. A source without pages of its own shows its canonical source's. Degraded drafts and pending claims show no page and
    ask for a review. All lists are reduced to one row for a source before they meet."""
    hash_of = snapshots.where(F.coalesce("source_uri", F.lit("")) != "").groupBy("source_uri").agg(F.max_by("content_hash", "seq").alias("content_hash"))
    real = duplicates.where((F.coalesce("source_uri", F.lit("")) != "") & (F.coalesce("canonical_uri", F.lit("")) != ""))
    twin = real.groupBy("source_uri").agg(F.max_by("canonical_uri", "seq").alias("canonical"))
    bad = F.coalesce("degraded", F.lit(False))
    live = history.where(~F.coalesce(F.col("verification_status").isin(*GONE), F.lit(False)))
    pending = F.coalesce(F.col("verification_status") == PENDING, F.lit(False)) | F.coalesce("provider_failed", F.lit(False))
    passed = F.lower(F.coalesce("validation_status", F.lit("passed"))).isin(*PASSED)
    shown = pages.where(~bad).select("source_uri", "target").unionByName(live.where(~pending & passed).select("source_uri", "target"))
    shown = shown.where((F.coalesce("source_uri", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    targets = shown.groupBy("source_uri").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    review = pages.where(bad).select("source_uri").unionByName(live.where(pending).select("source_uri")).where("source_uri IS NOT NULL").distinct().withColumn("review", F.lit(True))
    of_twin = targets.select(F.col("source_uri").alias("canonical"), F.col("targets").alias("twin_targets"))
    rows = hash_of.join(twin, "source_uri", "left").withColumn("canonical", F.coalesce("canonical", "source_uri")).join(targets, "source_uri", "left").join(of_twin, "canonical", "left").join(review, "source_uri", "left")
    found = F.coalesce("targets", "twin_targets", F.array().cast(STRINGS))
    status = F.when(F.col("canonical") != F.col("source_uri"), "duplicate").when(F.col("review"), "needs-review").otherwise("published")
    rows = rows.select("source_uri", "content_hash", status.alias("status"), found.alias("targets"), "review")
    return rows.where((F.size("targets") > 0) | F.col("review").isNotNull()).drop("review")

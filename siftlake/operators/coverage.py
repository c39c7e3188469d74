"""Offence–artifact–defence coverage: what a technique is watched by, and what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.logic import PASS, decay_status
from siftlake.functions.text import safe_key
from siftlake.operators.detections import DETECTIONS
from siftlake.session import fixed_table

# Trust per kind of evidence; anything else has the unknown trust.
TRUST = {
    "measured": 1.00,
    "skos_typed": 0.90,
    "ontology_axiom": 0.85,
    "doc_link": 0.80,
    "ontology_curated": 0.70,
    "curated": 0.65,
    "ctid_reroute": 0.50,
    "scf_strm": 0.45,
    "derived": 0.40,
    "artifact_cooccurrence": 0.25,
    "unmapped": 0.00,
}
UNKNOWN_TRUST = 0.30

# Hand-authored detect-phase defence per technique.
CURATED = (
    ("T1071", "D3-NTSA", "Network Traffic Signature Analysis"),
    ("T1048", "D3-NTCD", "Network Traffic Community Deviation"),
    ("T1110", "D3-CCSA", "Credential Compromise Scope Analysis"),
    ("T1490", "D3-EFA", "Emulated File Analysis"),
    ("T1003.001", "D3-PLA", "Process Lineage Analysis"),
)

# Artifact label to the OCSF class whose telemetry carries it.
ARTIFACT_CLASS = {
    "Network Traffic": 4001,
    "Network Flow": 4001,
    "Credential": 3002,
    "User Account": 3002,
    "Session": 3002,
    "Process": 1007,
    "Process Tree": 1007,
    "Cloud Storage": 6003,
    "Database": 6003,
    "Document File": 6003,
}

NOT_IN_CORPUS = "not in corpus (no shared-artifact join exists)"
ZERO_DEFENSE = "zero-defense: artifacts exist but no D3FEND technique watches them"
NO_LEAD = "no detect-band lead"
DETECT = "detect"
IMPORT_TTL_SECONDS = 30 * 86_400

COVERAGE_BUCKETS = ("fired", "covered", "dark_spot", "blind")
OVERLAY_BUCKETS = (
    "confirmed_fired",
    "predicted_covered_but_missed",
    "fired_but_noisy",
    "not_measured",
    "measured_only",
)


def trust_of(quality: Column) -> Column:
    """Trust of an edge by its kind of evidence."""
    out = F.lit(UNKNOWN_TRUST)
    for name, value in TRUST.items():
        out = F.when(quality == name, value).otherwise(out)
    return out


def weakest_trust(edges: DataFrame, key: str, trust: str = "trust") -> DataFrame:
    """A chain is as sound as its weakest edge; rows with a NULL trust stand for 'no edge'."""
    return edges.groupBy(key).agg(F.coalesce(F.min(trust), F.lit(0.0)).alias("weakest_trust"))


def derive_counters(monitors: DataFrame, produces: DataFrame) -> DataFrame:
    """A defence counters an offence when they share an artifact: ``(defense, offense, shared_artifacts)``.

    Both edge lists are reduced to distinct edges first, so every shared artifact joins once and the
    join yields one row per (defence, offence, artifact); a hot artifact is left to AQE to split.
    """
    watch = monitors.select("defense", "artifact").distinct()
    make = produces.select("offense", "artifact").distinct()
    return watch.join(make, "artifact").groupBy("defense", "offense").agg(F.count(F.lit(1)).alias("shared_artifacts"))


def covered_techniques(produces: DataFrame, monitors: DataFrame) -> DataFrame:
    """Offences with at least one countering defence; no pair is ever built."""
    watched = monitors.select("artifact").distinct()
    return produces.join(watched, "artifact", "left_semi").select("offense").distinct()


def blind_techniques(techniques: DataFrame, bridge: DataFrame) -> DataFrame:
    """Techniques without a detect-phase defence."""
    detect = bridge.filter(F.col("d3fend_tactic") == "Detect").select(
        F.col("attack_technique_id").alias("technique_id")
    )
    return techniques.select("technique_id").distinct().join(detect.distinct(), "technique_id", "left_anti")


def required_classes(names: Column) -> Column:
    """Sorted class ids for pipe-joined artifact labels; unknown labels give none."""
    pairs = [v for label, uid in ARTIFACT_CLASS.items() for v in (F.lit(label), F.lit(uid))]
    lookup = F.create_map(*pairs)
    ids = F.transform(F.split(names, r"\|"), lambda label: F.try_element_at(lookup, F.trim(label)))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(ids))), F.array().cast("array<int>"))


def required_ocsf_classes(edges: DataFrame, key: str, names: str = "shared_artifact_names") -> DataFrame:
    """Union of the classes required by all edges of a key. At most four distinct classes exist."""
    each = edges.select(key, F.explode_outer(required_classes(F.col(names))).alias("class_uid"))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("class_uid")).alias("required_classes"))


def _corpus_facts(corpus: DataFrame) -> DataFrame:
    """Everything coverage asks of a technique, from one grouping of the corpus.

    The class lists of detect cells are subsets of four ids, so few different ones exist.
    """
    cell_classes = F.when(F.col("band") == DETECT, required_classes(F.col("shared_artifact_names")))
    return corpus.groupBy(F.col("off_tech_id").alias("technique")).agg(
        F.bool_or(~F.col("band").isin("zero_defense", "_meta")).alias("has_cells"),
        F.bool_or(F.col("band") == "zero_defense").alias("is_zero_defense"),
        F.count_if(F.col("band") == DETECT).alias("n_detect"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(cell_classes)))).alias("detect_classes"),
    )


def corpus_membership(techniques: DataFrame, corpus: DataFrame) -> DataFrame:
    """``in_corpus`` and ``is_zero_defense`` per technique."""
    zero = F.coalesce("is_zero_defense", F.lit(False))
    member = F.coalesce(F.col("has_cells"), F.lit(False)) | zero
    joined = techniques.select("technique").distinct().join(_corpus_facts(corpus), "technique", "left")
    return joined.select("technique", member.alias("in_corpus"), zero.alias("is_zero_defense"))


def defenses_for(techniques: DataFrame, corpus: DataFrame, band: str = DETECT) -> DataFrame:
    """Defences of a band per technique, or one row with the reason why there can be none.

    Every edge is an intent-blind co-occurrence lead and carries that trust, whatever the corpus says.
    """
    member = corpus_membership(techniques, corpus)
    reason = F.when(~F.col("in_corpus"), NOT_IN_CORPUS).when(F.col("is_zero_defense"), ZERO_DEFENSE)
    cells = corpus.filter(F.col("band") == band).select(
        F.col("off_tech_id").alias("technique"),
        *[
            safe_key(F.col(c)).alias(c)
            for c in ("d3fend_id", "def_tech", "phase", "tactic", "shared_artifact_names")
        ],
        "shared_artifacts",
        F.lit("artifact_cooccurrence").alias("proxy_quality"),
        F.lit(TRUST["artifact_cooccurrence"]).alias("trust"),
        F.lit(True).alias("has_lead"),
    )
    judged = member.withColumn("reason", reason)
    joined = judged.join(cells, "technique", "left")
    keep = F.col("reason").isNotNull() | F.col("has_lead")
    blank = F.col("reason").isNotNull()
    names = ("d3fend_id", "def_tech", "phase", "tactic", "shared_artifact_names", "shared_artifacts", "proxy_quality")
    out = joined.filter(keep).select(
        "technique", *[F.when(~blank, F.col(c)).alias(c) for c in (*names, "trust")], "reason"
    )
    # a zero-defence technique has one reason row, even if stray cells exist for it
    return out.distinct()


def curated_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, "technique string, d3fend_id string, def_tech string", list(CURATED)).withColumn(
        "trust", F.lit(TRUST["ontology_curated"])
    )


def curated_defense_for(techniques: DataFrame) -> DataFrame:
    """The curated defence of a technique, NULL where there is none."""
    curated = F.broadcast(curated_table(techniques.sparkSession))
    return techniques.select("technique").distinct().join(curated, "technique", "left")


def hunt_inventory(spark: SparkSession) -> DataFrame:
    """The shipped hunts as the inventory that coverage is judged over."""
    return fixed_table(
        spark,
        "technique string, tactic string, class_uid int, has_detection boolean",
        [(d.technique, d.tactic, d.class_uid, True) for d in DETECTIONS],
    )


def coverage_status(inventory: DataFrame, by_class: DataFrame, fired: DataFrame, corpus: DataFrame) -> DataFrame:
    """Status per technique, with its design-time structure.

    ``inventory``: technique, tactic, class_uid, has_detection. ``by_class``: class_uid, n.
    ``fired``: technique, n_findings. A hunt whose class never landed is a dark spot; no hunt is blind.
    """
    landed = by_class.filter(F.col("n") > 0).select("class_uid", F.lit(True).alias("landed"))
    hits = fired.groupBy("technique").agg(F.max("n_findings").alias("n_findings"))
    curated = F.broadcast(curated_table(inventory.sparkSession)).select(
        "technique", F.col("trust").alias("curated_trust")
    )
    joined = (
        inventory.join(landed, "class_uid", "left")
        .join(hits, "technique", "left")
        .join(_corpus_facts(corpus), "technique", "left")
        .join(curated, "technique", "left")
    )
    zero = F.coalesce("is_zero_defense", F.lit(False))
    member = F.coalesce(F.col("has_cells"), F.lit(False)) | zero
    # a zero-defence technique has no edges, whatever stray cells say
    n_edges = F.when(~zero, F.col("n_detect"))
    no_classes = F.array().cast("array<int>")
    visible = F.coalesce("landed", F.lit(False))
    has_fired = F.coalesce(F.col("n_findings") > 0, F.lit(False))
    status = (
        F.when(~F.col("has_detection"), "blind")
        .when(~visible, "dark_spot")
        .when(has_fired, "fired")
        .otherwise("covered")
    )
    inferred = F.when(n_edges > 0, F.lit(TRUST["artifact_cooccurrence"]))
    return joined.select(
        "technique",
        "tactic",
        "class_uid",
        visible.alias("visible"),
        has_fired.alias("fired"),
        status.alias("status"),
        member.alias("in_corpus"),
        zero.alias("is_zero_defense"),
        F.coalesce(F.when(~zero, F.col("detect_classes")), no_classes).alias("required_classes"),
        F.coalesce(n_edges, F.lit(0).cast("bigint")).alias("inferred_edges"),
        F.coalesce(F.least(inferred, F.col("curated_trust")), F.lit(0.0)).alias("weakest_trust"),
    )


def bucket_summary(df: DataFrame, column: str, buckets: tuple[str, ...]) -> DataFrame:
    """Counts over a fixed bucket list, zeros kept, plus the total."""
    counts = [F.count_if(F.col(column) == b).alias(b) for b in buckets]
    return df.agg(*counts, F.count(F.lit(1)).alias("total"))


def coverage_summary(status: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == b).alias(b) for b in COVERAGE_BUCKETS]
    return status.agg(
        *counts,
        F.count(F.lit(1)).alias("total"),
        F.count_if("in_corpus").alias("in_corpus"),
        F.count_if("is_zero_defense").alias("zero_defense"),
    )


def _leads(subjects: DataFrame, corpus: DataFrame) -> DataFrame:
    """Detect-band leads of each subject technique, or one row with the reason for none."""
    edges = defenses_for(subjects, corpus)
    joined = subjects.select("technique").distinct().join(edges, "technique", "left")
    degrade = F.when(F.col("d3fend_id").isNull(), F.coalesce("reason", F.lit(NO_LEAD)))
    return joined.select(
        "technique", "d3fend_id", "def_tech", "phase", "shared_artifact_names", "trust", degrade.alias("degrade")
    )


def dark_spot_recommendation(status: DataFrame, corpus: DataFrame) -> DataFrame:
    """For dark spots only: the leads and the classes that would have to be landed."""
    dark = status.filter(F.col("status") == "dark_spot")
    landed = F.when(F.col("visible"), F.array("class_uid")).otherwise(F.array().cast("array<int>"))
    subjects = dark.select(
        "technique", "tactic", "class_uid", F.array_except("required_classes", landed).alias("classes_to_land")
    )
    return subjects.join(_leads(subjects, corpus), "technique")


def import_stale(validated_at: str | None, now: str, ttl_seconds: int = IMPORT_TTL_SECONDS) -> Column:
    """True when imported verdicts are too old, undated or from the future to be served as current."""
    stamp = F.lit(validated_at).cast("string")
    return decay_status(F.lit(PASS), stamp, now, ttl_seconds) != PASS


def measured_overlay(design: DataFrame, measured: DataFrame, validated_at: str | None, now: str) -> DataFrame:
    """Design-time status next to the measured verdict, with a reconciliation label.

    A technique without a usable verdict, or any technique of a stale import, is not_measured. The
    design-time trust is carried through as it is, and so are further columns of the measured table. Of several
    verdicts for one technique the worst counts: missed before noisy before detected, then the least precise.
    Technique ids are compared trimmed and in upper case.
    """
    stale = import_stale(validated_at, now)
    known = F.col("state").isin("DETECTED", "MISSED", "NOISY")
    usable = known & ~stale
    others = [c for c in measured.columns if c not in ("att_ck", "technique", "state", "precision", "matches", *design.columns)]
    place = F.when(F.col("state") == "MISSED", 0).when(F.col("state") == "NOISY", 1).when(F.col("state") == "DETECTED", 2)
    row = F.struct("state", "precision", "matches", *others)
    worst = F.min_by(row, F.struct(F.coalesce(place, F.lit(3)), "precision", "matches"))
    key = F.upper(F.trim("att_ck"))
    verdicts = measured.groupBy(key.alias("verdict_key")).agg(worst.alias("verdict")).select("verdict_key", "verdict.*")
    same = F.upper(F.trim(design["technique"])) == verdicts["verdict_key"]
    joined = design.join(verdicts, same, "left").withColumn("usable", F.coalesce(usable, F.lit(False)))
    label = (
        F.when(~F.col("usable"), "not_measured")
        .when(F.col("state") == "DETECTED", "confirmed_fired")
        .when(F.col("state") == "MISSED", "predicted_covered_but_missed")
        .otherwise("fired_but_noisy")
    )
    return joined.select(
        "technique",
        F.col("status").alias("design_status"),
        F.when(F.col("usable"), F.col("state")).otherwise("not_measured").alias("measured_state"),
        label.alias("reconciliation"),
        F.when(F.col("usable"), F.col("precision")).alias("precision"),
        F.when(F.col("usable"), F.col("matches")).alias("matches"),
        "weakest_trust",
        stale.alias("import_stale"),
        *others,
    )


def overlay_summary(overlay: DataFrame) -> DataFrame:
    return bucket_summary(overlay, "reconciliation", OVERLAY_BUCKETS)


def gap_countermeasures(overlay: DataFrame, corpus: DataFrame) -> DataFrame:
    """For measured misses only: the leads and the classes they would need."""
    missed = overlay.filter(F.col("reconciliation") == "predicted_covered_but_missed").select("technique")
    leads = _leads(missed, corpus)
    classes = required_ocsf_classes(leads, "technique").withColumnRenamed("required_classes", "ocsf_classes_to_land")
    return leads.join(classes, "technique", "left")


def gap_summary(gaps: DataFrame) -> DataFrame:
    per = gaps.groupBy("technique").agg(F.count("d3fend_id").alias("n_leads"))
    return per.agg(
        F.count(F.lit(1)).alias("measured_fn"),
        F.count_if(F.col("n_leads") > 0).alias("with_lead"),
        F.count_if(F.col("n_leads") == 0).alias("honest_degrade"),
    )

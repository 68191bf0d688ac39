"""Several labels for one table of reads, each in a column of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import labelling
from . import reads as read_ops

BY_SIGNATURE = ("data_driven_soft", "archetype")
BY_READ = ("hard_with_background", "hard_binary", "smoothed_hard_with_background")


def check(config: dict[str, dict]) -> None:
    """Raise before any work for an empty configuration, an unknown kind, or a distance other than Jaccard's."""
    if not config:
        raise ValueError("no labels are configured")
    for entry in config.values():
        if entry.get("type") not in BY_SIGNATURE + BY_READ:
            raise ValueError(f"unknown label {entry.get('type')!r}; known: {', '.join(sorted(BY_SIGNATURE + BY_READ))}")
        if entry.get("distance_name", "jaccard") != "jaccard":
            raise ValueError(f"unknown distance {entry['distance_name']!r}; known: jaccard")


def _by_signature(fit: DataFrame, entry: dict, classes: int, prior: DataFrame | None) -> DataFrame:
    """(name, signature, soft_label) of one entry, from the reads to learn from."""
    if entry["type"] == "archetype":
        kind = entry.get("ctype_prior_type", "uniform")
        if kind == "inv_global_freq" and prior is None:
            raise ValueError("inv_global_freq needs a prior")
        known = prior if kind == "inv_global_freq" else labelling.class_priors(fit, classes, kind)
        return labelling.archetype_labels(fit, labelling.archetype_models(fit, classes, entry.get("eps", 1e-10)), known, classes).withColumnRenamed("probabilities", "soft_label")
    least, distance = entry.get("min_reads", 30), entry.get("max_distance", 0.5)
    if entry.get("add_superset_counts", False):
        counts = settled(labelling.class_counts(fit, classes))
        return labelling.weighed(labelling.superset_pooled_counts(counts, classes, least, distance), labelling.counted_weights(counts, classes), classes)
    return labelling.pooled_soft_labels(fit, classes, least, distance) if entry.get("perform_pooling", True) else labelling.soft_labels(fit, classes)


def apply(rows: DataFrame, config: dict[str, dict], classes: int, fit_splits: list[str] | None = None, prior: DataFrame | None = None, fallback: str = "uniform") -> DataFrame:
    """rows with a column for each entry of config (column -> type and parameters) and, where one needs it, the signature, made once.

    Labels by signature are learned from the rows of fit_splits only (all, if None) and given to all; a (name, signature) that those lack
    has the uniform vector, or with fallback 'global_prior' the prior (original_label, prior). Columns of the configured names are replaced.
    """
    check(config)
    out = rows.drop(*config)
    needed = any(e["type"] in BY_SIGNATURE for e in config.values())
    if needed:
        out = settled(labelling.with_signature(out))
        fit = out if fit_splits is None else out.filter(F.col("split").isin(*fit_splits))
    own, target = F.col("original_label"), F.col("target_label")
    for column, entry in config.items():
        if entry["type"] in BY_SIGNATURE:
            held = out.withColumnRenamed("soft_label", "_held") if "soft_label" in out.columns else out
            labels = _by_signature(fit, entry, classes, prior)
            held = labelling.label_reads(held, labels, classes, prior if fallback == "global_prior" else None).withColumnRenamed("soft_label", column)
            out = held.withColumnRenamed("_held", "soft_label")
        elif entry["type"] == "hard_binary":
            out = out.withColumn(column, read_ops.hard_binary(own, target))
        elif entry["type"] == "hard_with_background":
            out = out.withColumn(column, read_ops.hard_with_background(own, target, classes).cast("int"))
        else:
            out = out.withColumn(column, read_ops.smoothed_with_background(own, target, classes, entry.get("epsilon", 0.1)))
    return out

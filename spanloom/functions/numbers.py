"""Scalar expressions on numbers, times and quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of node types and base costs and confidences of edge types.
SALIENCY = {"Error": 5.2, "Conclusion": 5.0, "Intent": 4.0, "Fact": 3.2, "Action": 3.0, "Planning": 2.5}
PRUNING_BONUS = {"Conclusion": 5.0, "Error": 4.8, "Intent": 3.5, "Fact": 3.2, "Action": 2.8, "Planning": 2.4}
EDGE_COST = {"Temporal": 1.3, "Call": 0.95, "Retry": 0.85, "AgentSpawn": 0.7, "Observation": 0.65, "SubagentReturn": 0.55, "Cognitive": 0.5}
CAUSAL_CONFIDENCE = {"SemanticValidation": 0.98, "SemanticOrigin": 0.98, "SemanticPropagation": 0.95, "SubagentReturn": 0.95, "AgentSpawn": 0.92, "SemanticRejection": 0.92, "Cognitive": 0.9, "reasoning_dependency": 0.9, "Observation": 0.85, "Call": 0.75, "EvidenceExposure": 0.72, "Retry": 0.7, "Temporal": 0.25, "answer_dependency": 1.0, "tool_observation_dependency": 0.85, "data_dependency": 0.8, "control_flow": 0.35, "same_step_neighbor": 0.2}
CLASS_COST = {"answer": 0.25, "validation": 0.30, "reasoning": 0.45, "tool_observation": 0.55, "data": 0.60, "control_flow": 1.35, "same_step_neighbor": 1.8}
SEVERITY = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.25}


def of(values: dict[str, float], key: Column, other: float) -> Column:
    """The value of a key, or ``other``."""
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, null if whole isn't positive."""
    return F.when(whole > 0, F.round(100.0 * part.cast("double") / whole.cast("double"), digits))


def edge_cost(kind: Column, score: Column) -> Column:
    """Cost of an edge on a path: its type's base, less for a high score."""
    return F.greatest(F.lit(0.05), of(EDGE_COST, kind, 1.1) + 0.8 * (1 - clamp(score)))


def causal_confidence(kind: Column, score: Column) -> Column:
    """Confidence that an edge carries a cause; fixed for edges that only tell of order, and where there is no score."""
    base = of(CAUSAL_CONFIDENCE, kind, 0.5)
    return F.when(kind.isin("Temporal", "control_flow", "same_step_neighbor") | (F.coalesce(score, F.lit(0.0)) <= 0), base).otherwise(F.greatest(F.lit(0.05), 0.75 * base + 0.25 * clamp(score)))


def dependency_class(kind: Column, target_type: Column) -> Column:
    """What sort of dependency an edge is; a type that names its sort keeps it."""
    named = F.regexp_replace(kind, "_dependency$", "")
    return (
        F.when(kind.isin("control_flow", "same_step_neighbor") | (kind != named), named)
        .when(kind.isin("Cognitive", "SemanticPropagation"), F.when(target_type == "Conclusion", "answer").otherwise("reasoning"))
        .when(kind == "Observation", "tool_observation").when(kind.isin("Call", "AgentSpawn", "SemanticOrigin"), "data")
        .when(kind.isin("SubagentReturn", "Retry", "reasoning_dependency"), "reasoning").when(kind == "SemanticValidation", "validation")
        .when(kind == "Temporal", "same_step_neighbor").otherwise("control_flow")
    )


def causal_cost(kind: Column, target_type: Column, score: Column) -> Column:
    """Cost of an edge on a causal path."""
    return F.greatest(F.lit(0.05), of(CLASS_COST, dependency_class(kind, target_type), 1.35) + 1.25 * (1 - causal_confidence(kind, score)))


def iso_duration_ms(text: Column) -> Column:
    """Milliseconds of an ISO duration; days are left out, a plain number counts as seconds."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"T.*?([0-9.]+){unit}", 1), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(0.0))
    iso = (part("H") * 3600 + part("M") * 60 + part("S")) * 1000
    return F.when(text.startswith("P"), iso).otherwise(text.try_cast("double") * 1000)


def nanos_iso(nanos: Column) -> Column:
    """ISO time of nanoseconds since the epoch."""
    return F.date_format(F.timestamp_micros(F.call_function("div", nanos.cast("long"), F.lit(1000).cast("long"))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def nanos_duration(start: Column, end: Column) -> Column:
    """ISO duration between two times in nanoseconds; never negative, empty without an end."""
    span = F.greatest(end.cast("long") - start.cast("long"), F.lit(0)) / 1e9
    return F.when(end.isNull() | start.isNull(), "").otherwise(F.format_string("PT%.6fS", span))


def k8s_quantity(text: Column) -> Column:
    """A quantity such as 250m, 1Gi or 100n as a number; null if it isn't one."""
    # Suffixes of quantities.
    scale = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3, "Ti": 1024.0**4}
    number, unit = F.regexp_extract(text, r"^([0-9.]+)([A-Za-z]*)$", 1), F.regexp_extract(text, r"^([0-9.]+)([A-Za-z]*)$", 2)
    factor = F.lit(None).cast("double")
    for k, v in scale.items():
        factor = F.when(unit == k, F.lit(v)).otherwise(factor)
    return F.nullif(number, F.lit("")).try_cast("double") * factor


def threshold_status(value: Column, warn: float, critical: float) -> Column:
    """ok, warning or critical; unknown for null."""
    return F.when(value.isNull(), "unknown").when(value >= critical, "critical").when(value >= warn, "warning").otherwise("ok")


STATUS_RANK = {"unknown": 0, "ok": 1, "warning": 2, "critical": 3}


def lenient_int(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """An integer in a text, within bounds; null if there is none."""
    out = F.trim(text).try_cast("double").cast("int")
    out = F.greatest(out, F.lit(low)) if low is not None else out
    return F.when(out.isNotNull(), F.least(out, F.lit(high)) if high is not None else out)


def lenient_bool(text: Column) -> Column:
    """Yes or no in words or figures; null for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "1", "是", "对"), True).when(t.isin("false", "no", "n", "0", "否", "不"), False)

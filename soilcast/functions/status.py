"""Column expressions for thresholds, urgency and status labels (all JVM-side CASE expressions)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from soilcast import schema as S


def threshold_status(m: Column, critical: float = S.CRITICAL_THRESHOLD, watering: float = S.WATERING_THRESHOLD,
                     style: str = "curve") -> Column:
    """CRITICAL / NEEDS_WATERING / HEALTHY (curve) or CRITICAL / WARNING / OK (service)."""
    mid, top = ("NEEDS_WATERING", "HEALTHY") if style == "curve" else ("WARNING", "OK")
    return F.when(m <= critical, "CRITICAL").when(m <= watering, mid).otherwise(top)


def threshold_colour(m: Column, critical: float = S.CRITICAL_THRESHOLD, watering: float = S.WATERING_THRESHOLD) -> Column:
    return F.when(m <= critical, "red").when(m <= watering, "orange").otherwise("green")


def urgency_level(hours: Column) -> Column:
    """Urgency of a forecast that lies ``hours`` ahead."""
    return F.when(hours < 12, "HIGH").when(hours < 48, "MEDIUM").otherwise("LOW")


def urgency_status(urgency: Column) -> Column:
    """Service status of an urgency; unknown values map to OK."""
    return F.when(urgency == "CRITICAL", "CRITICAL").when(urgency == "HIGH", "WARNING").otherwise("OK")


def immediate_urgency(current: Column, critical: float = S.CRITICAL_THRESHOLD,
                      watering: float = S.WATERING_THRESHOLD) -> Column:
    """CRITICAL / HIGH when the newest reading is already at a threshold, else null."""
    return F.when(current <= critical, "CRITICAL").when(current <= watering, "HIGH")


# Fixed texts of the immediate-need branch, per method family (ml, others).
IMMEDIATE_MESSAGES = {
    ("ml", "CRITICAL"): "Immediate watering required - critically dry!",
    ("ml", "HIGH"): "Watering recommended now",
    ("other", "CRITICAL"): "Plant needs immediate watering - critically dry!",
    ("other", "HIGH"): "Plant needs watering now",
}
IMMEDIATE_CONFIDENCE = {
    ("ml", "CRITICAL"): 0.95, ("ml", "HIGH"): 0.9,
    ("other", "CRITICAL"): 0.99, ("other", "HIGH"): 0.95,
}


def immediate_message(urgency: Column, ml: Column) -> Column:
    m = IMMEDIATE_MESSAGES
    return (F.when(ml & (urgency == "CRITICAL"), m[("ml", "CRITICAL")])
            .when(ml & (urgency == "HIGH"), m[("ml", "HIGH")])
            .when(urgency == "CRITICAL", m[("other", "CRITICAL")])
            .when(urgency == "HIGH", m[("other", "HIGH")]))


def immediate_confidence(urgency: Column, ml: Column) -> Column:
    c = IMMEDIATE_CONFIDENCE
    return (F.when(ml & (urgency == "CRITICAL"), c[("ml", "CRITICAL")])
            .when(ml & (urgency == "HIGH"), c[("ml", "HIGH")])
            .when(urgency == "CRITICAL", c[("other", "CRITICAL")])
            .when(urgency == "HIGH", c[("other", "HIGH")]))

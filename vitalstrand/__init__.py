"""Longitudinal health-signal analytics as Spark DataFrame jobs."""

from vitalstrand.config import StudyParams
from vitalstrand.plans.study import Study

__all__ = ["Study", "StudyParams"]

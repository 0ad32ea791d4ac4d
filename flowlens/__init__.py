"""flowlens: workflow run history, telemetry and manifests as Spark DataFrames."""

from flowlens.engine import Engine, tune

__all__ = ["Engine", "tune"]

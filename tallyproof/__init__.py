"""Survey-weighted statistics and claim checking as Spark jobs."""

from .catalog import Catalog, Design, Variable, WaveCatalog, WaveVariable
from .survey import Survey

__all__ = ["Catalog", "Design", "Survey", "Variable", "WaveCatalog", "WaveVariable"]

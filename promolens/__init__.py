"""promolens: competitive promotion analytics as Spark DataFrame jobs."""

from promolens.params import Params
from promolens.vocabulary import Vocabulary

__all__ = ["Params", "Vocabulary"]

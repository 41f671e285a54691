"""Imports every module that registers queries."""

from hostvigil.operators import cards, forecast, frames, incidents, models, windows  # noqa: F401
from hostvigil.plans import evaluation, probes, tables  # noqa: F401
from hostvigil.sources import samples  # noqa: F401
from hostvigil.streaming import scoring, streams  # noqa: F401

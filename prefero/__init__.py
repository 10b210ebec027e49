"""Choice models over Spark tables; training-data operators are in ``prefero.llm``."""

from prefero.operators.mdcev import MDCEV
from prefero.operators.mnl import MNL
from prefero.operators.mnp import MNP
from prefero.operators.morp import MORP
from prefero.sources.tables import read_table

__all__ = ["MDCEV", "MNL", "MNP", "MORP", "read_table"]

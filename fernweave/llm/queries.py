"""The queries of this subpackage, by name, and the DuckDB equivalents of those that SQL can express."""

from __future__ import annotations

from .bitpack import op4_packed_ids
from .chat import OP9_SQL, op9_chat
from .media import op8_media
from .mixing import OP6_SQL, op6_mixing
from .neighbours import op1_neighbours
from .packing import op2_packing
from .passages import op7_passages
from .sharding import op5_sharding
from .simhash import op10_simhash
from .toxicity import op3_toxicity

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_packed_ids": op4_packed_ids,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_passages": op7_passages,
    "op8_media": op8_media,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": OP6_SQL,
    "op9_chat": OP9_SQL,
}

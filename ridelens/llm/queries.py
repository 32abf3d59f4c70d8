"""All queries of this subpackage; importing it registers them."""

import importlib

from ridelens.llm.base import ORACLES, QUERIES

for _name in ("lattice_lm", "exact_dedup", "language_id", "mixing", "chat", "jaccard_join", "block_labeller", "piece_codec", "edit_fingerprint", "url_filter",
              "collocations", "turn_repair", "toxic_segments"):
    importlib.import_module(f"ridelens.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]

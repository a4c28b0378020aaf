"""Plan helpers: lineage cuts, size-checked broadcasts, hot keys."""

from quillmill.plans.lineage import checkpointed, dropped, shared_dir, written
from quillmill.plans.pairing import split_join
from quillmill.plans.sizing import BROADCAST_ROWS, broadcast_if_small, joined_in_parts, looked_up, row_count_at_most, split_hot

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "checkpointed", "dropped", "joined_in_parts", "looked_up", "row_count_at_most", "shared_dir", "split_hot", "split_join", "written"]

"""The mechanisms are stateless projections, so a stream is privatised by the batch expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.config import Run
from ..plans.privatise import Fitted, privatise


def privatise_stream(stream: DataFrame, fitted: Fitted, runs: Sequence[Run], **options) -> DataFrame:
    """Privatise a streaming DataFrame with ranges fitted on a batch table.

    ``fitted`` must come from data that may be used for it: the train ranges are not private. The result is a
    streaming DataFrame; a restarted query repeats the same noise, as noise depends on the row key only.
    """
    if not stream.isStreaming:
        raise ValueError("privatise_stream expects a streaming DataFrame; use plans.privatise for a batch")
    return privatise(stream, fitted, runs, **options)

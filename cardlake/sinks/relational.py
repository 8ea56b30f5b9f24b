"""Writing to relational tables over JDBC; credentials come in with the properties."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str],
    mode: str = "overwrite",
    connections: int | None = None,
) -> None:
    """Write with one connection per partition, or with at most ``connections``; rows are not shuffled for that.

    Each partition is one transaction. An executor lost after its commit can have its rows sent
    twice, so hand in a stored mart and repeat a failed ``overwrite`` as a whole.
    """
    narrow = df if connections is None else df.coalesce(connections)
    narrow.write.jdbc(
        url=url, table=table, mode=mode, properties={"batchsize": "10000", **properties}
    )

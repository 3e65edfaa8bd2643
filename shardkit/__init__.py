"""Tables split into numbered shards over several islands, as Spark jobs."""

from shardkit.functions.names import shard_name, shard_no
from shardkit.operators.federate import union_shards, union_sources
from shardkit.operators.weights import custom_weights, default_weights, island_weights
from shardkit.plans.rebalance import rebalance

__all__ = [
    "custom_weights",
    "default_weights",
    "island_weights",
    "rebalance",
    "shard_name",
    "shard_no",
    "union_shards",
    "union_sources",
]

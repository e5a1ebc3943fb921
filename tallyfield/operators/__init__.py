from . import lineage, messages, metadata, policy, preview, ranking, sales

__all__ = ["lineage", "messages", "metadata", "policy", "preview", "ranking", "sales"]

"""Table analytics on Spark: sales aggregates, table lineage, metadata search, previews, stored chats.

Functions take DataFrames and return DataFrames; none of them keeps a session.
"""

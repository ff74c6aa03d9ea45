"""Conversation-transcript analytics on Spark.

``sources`` reads transcripts, ``operators`` turns them into a ledger of turns and per-session digests,
``functions`` holds the column expressions, ``streaming`` the continuous jobs and ``plans`` the end-to-end
jobs and the registered queries with their SQL twins.
"""

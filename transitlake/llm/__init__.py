"""Operators for large training-text corpora; nothing else in the library imports this package.

tokens       token counts, two-tier map-side lookup (2)      pii       personal data by anchor expansion (6)
preference   chosen/rejected chat formatting (3)             topk      exact top-k by block bounds (7)
buckets      optimal length buckets and batches (4)          quality   random-indexing classifier (8)
embed_dedup  near vectors by sorted projections (5)          secrets   blob ledger of secret findings (9)
minhash      near-duplicate texts by weighted sampling (1)   mixing    source mixing by subset-sum fitting (10)
filter_audit what each filter removes, packed counters (11)  fim       fill-in-the-middle on piece tables (13)
exact_dedup  exact copies by tree-merge of digest runs (12)
"""

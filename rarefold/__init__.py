"""rarefold: imbalance-aware text classification experiments as Spark jobs.

Modules are plain functions ``DataFrame -> DataFrame``; iterative learners
keep only small model state (matrices, stumps) on the driver and recompute
row state from broadcast models, so data rows stay distributed.
"""

__all__ = ["session"]

"""Model-evidence analytics on Spark: tables in; contract violations, tensor results, parity verdicts
and a decision report out. The subpackage `llm` holds training-data operators and stands alone."""

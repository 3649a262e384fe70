"""Import every operator module so that its query registers."""

from procsig.llm import attention_lm, bpe, chat, decontam, dedup, divergence, licenses, quality, resample, secrets, token_edits, toxicity, urls  # noqa: F401
from procsig.llm.registry import ORACLE, QUERIES  # noqa: F401

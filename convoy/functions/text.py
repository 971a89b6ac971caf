"""Text expressions: question guard, hash embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.functions.coerce import strip

# --- fixed values: patterns that mark a question as an injection attempt ----------------
INJECTION_PATTERNS = (
    r"ignore (all )?(previous|prior|above) instructions",
    r"disregard (your|the) system prompt",
    r"you are now (dan|unrestricted|jailbreak)",
    r"reveal (your )?(system prompt|hidden instructions|api keys?|secrets?)",
    r"exfiltrate",
    r"print env(ironment)? variables",
    r"Authorization:\s*Bearer",
    r"ANTHROPIC_API_KEY|OPENAI_API_KEY|LLM_API_KEY|NEXTAUTH_SECRET",
    r"tool[s]?\s+outside|call\s+any\s+tool",
    r"sudo\s|rm\s+-rf",
)
WRAPPER = r"(?is)```(?:system|assistant).*?```"
MAX_QUESTION = 2000
DIM = 384
# ---------------------------------------------------------------------------------------


def any_injection() -> str:
    return "(?i)(" + "|".join(f"({p})" for p in INJECTION_PATTERNS) + ")"


def question_reason(question: Column, max_len: int = MAX_QUESTION) -> Column:
    """Why a question is refused; null when it is allowed. The whole text is searched."""
    q = strip(F.coalesce(question, F.lit("")))
    return (
        F.when(F.length(q) == 0, "empty question")
        .when(F.length(q) > max_len, f"question exceeds {max_len} characters")
        .when(q.rlike(any_injection()), "prompt injection pattern rejected")
    )


def without_wrappers(question: Column) -> Column:
    """The question without role-play blocks."""
    return strip(F.regexp_replace(strip(question), WRAPPER, ""))


def _embedded(texts: pa.Array) -> pa.Array:
    """The embeddings of a batch: digests are chained text by text, all else is one flat array."""
    digests = []
    for text in texts.drop_null().to_pylist():
        digest = hashlib.sha256(text.encode()).digest()
        for _ in range(-(-DIM // 8)):
            digest = hashlib.sha256(digest).digest()
            digests.append(digest)
    rows = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, -(-DIM // 8) * 8)[:, :DIM]
    values = rows / 4294967295.0 * 2.0 - 1.0
    values /= np.sqrt((values * values).sum(axis=1, keepdims=True))
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    offsets = pa.array(np.append(0, np.cumsum(known * DIM)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=pa.array(~known))


def hash_embedding(text: Column) -> Column:
    """Deterministic unit vector from a chain of SHA-256 digests of the text; null for a null text.

    Every digest after the first gives eight big-endian 32-bit numbers, scaled to [-1, 1]. A chain of
    digests has no vectorised form in SQL functions, where it takes strings and nested lambdas, so
    Arrow batches are worked on.
    """
    return F.arrow_udf(_embedded, T.ArrayType(T.DoubleType()))(text.cast("string"))

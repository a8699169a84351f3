"""Hash helpers as Spark SQL text."""

from __future__ import annotations


def md5_int(text: str) -> str:
    """First 32 bits of md5 as a bigint."""
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def md5_wide(text: str) -> str:
    """First 60 bits of md5 as a bigint: positions and draws far beyond 32 bits stay reachable and even."""
    return f"CAST(conv(substring(md5({text}), 1, 15), 16, 10) AS BIGINT)"


def salted_sha(salt: str, key: str, separator: str = "char(0)") -> str:
    """sha256 of salt, separator and key; the key is SQL, the salt a plain string."""
    return f"sha2(concat('{salt}', {separator}, {key}), 256)"

"""Named queries over the driver's tables and the SQL that states the same."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: White space as the engine's ``(?U)\s``, in RE2.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def count(pattern: str, c: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


#: One row per sample, chunk and evaluated answer: the first delivery.
SFT = "(SELECT * FROM sft_sample QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ordinal) = 1)"
CHUNK = "(SELECT * FROM cleaned_chunk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) = 1)"
EVAL = "(SELECT * FROM evaluation_result QUALIFY row_number() OVER (PARTITION BY model_name, benchmark_id ORDER BY ordinal) = 1)"

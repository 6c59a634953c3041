"""CRC-32 in DuckDB's SQL, for the statements beside the queries."""

CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def crc(column: str) -> str:
    """CRC-32 of a column's decimal text; the table ``crc_table`` must be joined."""
    codes = f"list_prepend(4294967295, list_transform(string_split({column}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"

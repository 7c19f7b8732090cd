"""Pieces of DuckDB SQL shared by the twins of the training-data queries."""

#: One row with ``t``, the table of crc32 by byte, made from its rule (the reflected polynomial EDB88320).
CRC_TABLE_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text column, where ``crc_table`` is in the FROM clause."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")

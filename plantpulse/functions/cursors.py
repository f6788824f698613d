"""Opaque keyset cursors (Q4): base64url without padding of `<epoch micros>|<id>`."""

from __future__ import annotations

import base64
import binascii
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def cursor_token(time: Column, row_id: Column) -> Column:
    raw = F.concat_ws("|", F.unix_micros(time).cast("string"), row_id)
    return F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def cursor_parts(token: Column) -> Column:
    """struct(time, id) of a token, NULL when it is not one."""
    std = F.translate(token, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), "=")
    raw = F.when(
        token.rlike(r"\A[A-Za-z0-9_-]+\z"),
        F.try_to_binary(padded, F.lit("base64")).cast("string"),
    )
    us = F.regexp_extract(raw, r"\A(-?\d+)\|", 1).try_cast("bigint")
    row_id = F.regexp_extract(raw, r"(?s)\A-?\d+\|(.+)\z", 1)
    return F.when(us.isNotNull() & (row_id != ""), F.struct(F.timestamp_micros(us).alias("time"), row_id.alias("id")))


def encode_cursor(time: datetime, row_id: str) -> str:
    delta = time - EPOCH
    us = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return base64.urlsafe_b64encode(f"{us}|{row_id}".encode()).decode().rstrip("=")


def decode_cursor(token: str) -> tuple[datetime, str]:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", token or ""):
        raise ValueError("malformed cursor")
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
    except (binascii.Error, UnicodeDecodeError):
        raise ValueError("malformed cursor") from None
    micros, bar, row_id = raw.partition("|")
    if not bar or not row_id or not re.fullmatch(r"[+-]?\d+", micros):
        raise ValueError("malformed cursor")
    return EPOCH + timedelta(microseconds=int(micros)), row_id

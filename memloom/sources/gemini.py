"""Decoder of captured batch-execute responses, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The anti-hijack prefix, the envelope's name, the beginnings of strings that are ids or links, the form of ids.
PREFIX, ENVELOPE = ")]}'", "wrb.fr"
NO_TEXT = ("c_", "r_", "rc_", "$", "http")
ID = re.compile(r"[cr]c?_[0-9a-f]+")
#: Longer strings are text, and so many ids of a turn are kept.
MIN_TEXT, MAX_IDS = 40, 3

NUMBER = re.compile(r"^[ \t]*\d+[ \t]*\r?\n", re.M)


def envelopes(text: str | None) -> Iterator[tuple[str, str]]:
    """(rpcid, payload as JSON text) of each envelope.

    A response is a sequence of a line with a number and JSON over one or more lines. The numbers are not used: a
    JSON decoder finds each value's end, and text that is none is skipped to the next number.
    """
    text = (text or "").lstrip().removeprefix(PREFIX)
    decoder = json.JSONDecoder()
    at = 0
    while m := NUMBER.search(text, at):
        start = m.end()
        while start < len(text) and text[start].isspace():
            start += 1
        try:
            chunk, at = decoder.raw_decode(text, start)
        except ValueError:
            at = start
            continue
        for entry in chunk if isinstance(chunk, list) else []:
            if isinstance(entry, list) and len(entry) > 2 and entry[0] == ENVELOPE:
                payload = entry[2]
                if isinstance(payload, str) and payload:
                    try:
                        payload = json.loads(payload)
                    except ValueError:
                        pass
                yield str(entry[1]), json.dumps(payload, ensure_ascii=False)


def strings(node) -> Iterator[tuple[int, str]]:
    """(place, string) of all strings of a JSON value, in the order of the text."""
    stack, place = [node], 0
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield place, x
            place += 1
        elif isinstance(x, (list, dict)):
            stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x))


def speech(turn) -> tuple[list[str], str, str] | None:
    """ids, user text and model text of a turn, chosen by place and length in one pass; None without a text."""
    ids: dict[str, int] = {}
    user: tuple[int, str] | None = None
    model = (0, 0, "")
    for place, s in strings(turn):
        if ID.fullmatch(s):
            ids.setdefault(s, place)
        if len(s) <= MIN_TEXT or s.startswith(NO_TEXT):
            continue
        if user is None:
            user = (place, s)
        else:
            model = max(model, (len(s), -place, s))
    return (sorted(ids, key=ids.get)[:MAX_IDS], user[1], model[2]) if user else None


def turns(payload: str | None) -> Iterator[tuple[int, list[str], str, str]]:
    """(number, ids, user text, model text) of each turn: the first long string, and the longest of the others."""
    value = json.loads(payload) if payload else None
    listed = value[0] if isinstance(value, list) and value else None
    for number, turn in enumerate(listed if isinstance(listed, list) else []):
        if isinstance(turn, list) and (found := speech(turn)):
            yield number, *found


def decode(raw: DataFrame) -> DataFrame:
    """rpcid and payload of every envelope in texts (column value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():  # one response at a time: captures can be long
                found = list(envelopes(text))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["rpcid", "payload"])

    return raw.select("value").mapInArrow(run, "rpcid string, payload string")


def decode_turns(decoded: DataFrame) -> DataFrame:
    """rpcid, turn, ids, user_text, model_text of every turn in decoded payloads."""
    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rpcid, *t) for rpcid, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in turns(payload)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=["rpcid", "turn", "ids", "user_text", "model_text"])

    return decoded.select("rpcid", "payload").mapInArrow(run, "rpcid string, turn int, ids array<string>, user_text string, model_text string")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return decode_turns(decode(spark.read.text(path, wholetext=True)))

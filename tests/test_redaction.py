"""Redaction of free-form JSON at any depth."""

import json
import random
import re

from ridelens.functions.redaction import sensitive_name
from ridelens.operators import rows


def leaks(value, key=""):
    """Every leaf under a sensitive key that is neither null nor the marker, and every path left in a string."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaks(v, k)]
    if isinstance(value, list):
        return [x for v in value for x in leaks(v, key)]
    if sensitive_name(key):
        return [] if value is None or value == "[redacted]" else [value]
    return [value] if isinstance(value, str) and "/home/" in value else []


def made(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(["a", "latitude", "lon", "file_path", "note", "x y", "ключ"]): made(rng, depth - 1) for _ in range(rng.randrange(5))}
    return [rng.randrange(-5, 10**18), rng.random(), rng.choice([None, True, False]), rng.choice(["", "ok", "see /home/ab.mp4", "/home/ride/x.json!", 'q"\\é'])][kind]


def test_nothing_sensitive_is_left(spark):
    rng = random.Random(4)
    values = [{"top": made(rng, 6)} for _ in range(300)]
    texts = [json.dumps(v) for v in values] + [None, "", "{", '{"latitude": 31.25, "p": "/home/x.mp4"', "[" * 100_000, '"/home/x.mp4"', "12"]
    got = [r.t for r in rows.redact_json_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()]
    for before, after in zip(values, got):
        after = json.loads(after)
        assert not leaks(after)
        if not any(sensitive_name(k) for k in re.findall(r'"([^"]+)": ', json.dumps(before, ensure_ascii=False))) and "/home/" not in json.dumps(before):
            assert after == before
    odd = got[len(values):]
    assert odd[0] is None and odd[1:3] == ["", "{"] and odd[3] == '{"latitude": null, "p": "[path]"' and len(odd[4]) == 100_000 and odd[5:] == ['"[path]"', "12"]


def test_nested_values_of_a_json_object(spark):
    df = spark.createDataFrame([('{"a":{"latitude":31.2},"l":[{"lon":2.5}],"lat":3}',)], "t string")
    assert rows.redact_json_object(df, "t").first().t == {"a": '{"latitude":null}', "l": '[{"lon":null}]', "lat": None}
    assert rows.redact_json_text(df, "t").first().t == '{"a":{"latitude":null},"l":[{"lon":null}],"lat":null}'
    assert rows.redact_json_text(df.where("false"), "t").count() == 0

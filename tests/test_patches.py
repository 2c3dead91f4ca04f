"""A reply's instructions against a plain loop over them."""

import json

import numpy as np

from cadenza.operators import patches as P

KNOWN = {"drop", "drop_var", "intro", "intro_full", "build", "breakdown", "outro"}


def number(x):
    return isinstance(x, (int, float))


def naive(text, slots, duration, bar, grain):
    """(slots after the reply, how many instructions had a slot, note)."""
    slots = {k: dict(v) for k, v in slots.items()}
    try:
        reply = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return slots, 0, ""
    items = reply.get("slots")
    applied = 0
    for item in items if isinstance(items, list) else []:
        try:
            slot = slots[int(item["index"])]
        except (KeyError, TypeError, ValueError, IndexError):
            continue
        pattern, gain, start, label = (item.get(f) for f in P.FIELDS)
        if isinstance(pattern, str) and pattern in KNOWN:
            slot["drum_pattern"] = pattern
        if number(gain) and 0 <= gain <= 1:
            slot["source_gain"] = float(gain)
        if number(start) and 0 <= start < duration:
            line = max(1, grain) * bar
            moved = round(start / line) * line if line > 0 else 0.0
            if 0 <= moved < duration:
                slot["source_start"] = moved
        if isinstance(label, str) and label:
            slot["source_label"] = label[:32]
        applied += 1
    return slots, applied, str(reply.get("note", ""))[:200] if applied else ""


def test_patches_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    pick = lambda *c: c[int(rng.integers(0, len(c)))]
    plans, slots, replies = [], {}, {}
    for p in range(150):
        plans.append((p, float(pick(16, 30, 64)), float(pick(2.0, 1.7, 0.0)), pick(0, 1, 2)))
        slots[p] = {k: {"drum_pattern": "drop", "source_gain": 0.5, "source_start": 0.0, "source_label": f"s{k}"} for k in range(4)}
        items = []
        for _ in range(int(rng.integers(0, 9))):
            item = {"index": pick(0, 1, 2, 3, 4, -1, 1.9, "2", " 3 ", "x", None, True, [1], 2)}
            for f, values in zip(P.FIELDS, (("build", "outro", "polka", "", 3, None), (0, 1, 0.25, 1.5, -0.1, "0.5", True, None), (0, 3, 5.1, 15.9, 15.9, 29.9, 64, -1, "8", False, None), ("hook", "é" * 40, "", 7, None)), strict=True):
                if rng.random() < 0.7:
                    item[f] = pick(*values)
            items.append(pick(item, item, item, item, 5, "text", None))
        note = pick("a line", "n" * 300, "")
        text = json.dumps({"note": note, "slots": items}, ensure_ascii=False)
        replies[p] = pick(f"Sure! {text}\nDone", text, text, text, text[:-3], "no object", "", json.dumps({"note": note, "slots": {"index": 1}}), json.dumps({"slots": None}), "{" + text)
    table = spark.createDataFrame([(p, k, *s.values()) for p, own in slots.items() for k, s in own.items()], "plan int, slot int, drum_pattern string, source_gain double, source_start double, source_label string")
    asked = spark.createDataFrame([*replies.items(), (999, '{"slots":[{"index":0}]}')], "plan int, reply string")
    found = P.instructions(asked, table, spark.createDataFrame(plans, "plan int, duration double, bar double, grain int"), "plan").cache()
    got = {(r["plan"], r["slot"]): r for r in P.patched(table, found, "plan").collect()}
    notes = {r["plan"]: r for r in P.notes(asked, found, "plan").collect()}
    assert len(got) == 600
    for p, duration, bar, grain in plans:
        want, applied, note = naive(replies[p], slots[p], duration, bar, grain)
        for k, s in want.items():
            for f, v in s.items():
                assert got[p, k][f] == v or abs(got[p, k][f] - v) < 1e-9, (p, k, f, replies[p])
        assert notes[p]["usable"] == (applied > 0) and notes[p]["note"] == note, (p, replies[p])
    reasons = {r["reason"] for r in found.collect()}
    assert reasons == {None, "no slot", "no such slot", "no text", "no number", "no such pattern", "not from 0 to 1", "outside of the source", "no line of the source there", "empty"}
    assert all((r["reason"] is None) == r["taken"] for r in found.collect()) and notes[999]["usable"] is False
    assert P.patched(table, found.limit(0), "plan").where("taken + refused > 0").count() == 0


def _plain(spark, build):
    """The optimized and the physical plan of what build makes, without broadcasts and changes while it runs."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        done = build()._jdf.queryExecution()
        return done.optimizedPlan().toString(), done.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_slots_are_shuffled_once_for_the_lookup_and_only_outcomes_go_to_it(spark):
    slots = spark.createDataFrame([(1, 0, "drop", 0.5, 0.0, "a")], "plan int, slot int, drum_pattern string, source_gain double, source_start double, source_label string").repartition(2)
    asked, plans = spark.createDataFrame([(1, '{"slots":[{"index":0}]}')], "plan int, reply string").repartition(2), spark.createDataFrame([(1, 30.0, 2.0, 1)], "plan int, duration double, bar double, grain int").repartition(2)
    logical, physical = _plain(spark, lambda: P.patched(slots, P.instructions(asked, slots, plans, "plan"), "plan"))
    # instructions and plans by plan, instructions, known slots and slots by plan and slot; known slots were shuffled again, as their numbers had another type
    assert physical.count("Exchange hashpartitioning") == 5
    lines = logical.splitlines()
    below = lines[max(i for i, x in enumerate(lines) if "Join LeftOuter" in x) + 1]  # what is joined with the known slots
    assert "no_source_gain" in below and not any(x in below.split("CASE")[0] for x in ("duration", "grain", "has_"))


def test_odd_rows_of_replies_slots_and_plans(spark):
    table = [(1, 0, "drop", 0.5, 0.0, "a"), (1, 0, "drop", 0.6, 0.0, "b"), (1, None, "drop", 0.7, 0.0, "c"), (None, 0, "drop", 0.8, 0.0, "d"), (2, 0, None, None, None, None)]
    slots = spark.createDataFrame(table, "plan int, slot int, drum_pattern string, source_gain double, source_start double, source_label string")
    said = '{"slots":[{"index":0,"source_gain":0.25,"source_start":5},{"index":0,"source_gain":2},{"index":null,"source_gain":0.1},{"index":7,"source_label":"x"},{"index":0}]}'
    asked = spark.createDataFrame([(1, said), (None, said), (2, None), (3, said)], "plan int, reply string")
    plans = spark.createDataFrame([(1, None, 2.0, 1), (None, 30.0, 2.0, 1), (2, 30.0, 2.0, 1)], "plan int, duration double, bar double, grain int")
    found = P.instructions(asked, slots, plans, "plan")
    assert found.columns == ["plan", "k", "slot", "field", "value", "number", "taken", "reason"] and dict(found.dtypes)["slot"] == "bigint"
    want = {(1, 0, 0, "source_gain", 0.25, True, None), (1, 0, 0, "source_start", None, False, "outside of the source"), (1, 1, 0, "source_gain", None, False, "not from 0 to 1"), (1, 2, None, None, None, False, "no slot"), (1, 3, 7, None, None, False, "no such slot"), (1, 4, 0, None, None, True, None)}
    rows = [(r["plan"], r["k"], r["slot"], r["field"], r["number"], r["taken"], r["reason"]) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want and found.where("value is not null").count() == 0
    got = sorted((tuple(r) for r in P.patched(slots, found, "plan").collect()), key=repr)
    assert got == sorted([(1, 0, "drop", 0.25, 0.0, "a", 1, 2), (1, 0, "drop", 0.25, 0.0, "b", 1, 2), (1, None, "drop", 0.7, 0.0, "c", 0, 0), (None, 0, "drop", 0.8, 0.0, "d", 0, 0), (2, 0, None, None, None, None, 0, 0)], key=repr)

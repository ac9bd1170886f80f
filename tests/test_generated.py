"""Names and batches of generated records against the same done one by one."""

import random

import pytest

from cataloom.operators import generated, keys

LINK = "struct<from_logic_id:string,from_output:string,to_input:string,kind:string,link_explanation:string>"
SPEC = f"id string, name string, kind string, m int, purpose string, archived boolean, links array<{LINK}>, position int"
CONTENT = ["name", "kind", "m", "purpose"]


def brute_names(taken, wishes):
    used, out = {t.strip().lower() for t in taken if t.strip()}, []
    for w in wishes:
        name, n = w.strip(), 2
        got = name
        while name and got.lower() in used:
            got, n = f"{name} ({n})", n + 1
        used |= {got.lower()} if name else set()
        out.append(got)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["Rule", "rule", "B", " B "]) + rng.choice(["", "", " (2)", " (3)", " (4)", " (2) (2)", " (2) (3)", " (10)", "(2)", " (02)", " (1)"])
    taken, wishes = [name() for _ in range(4 * seed)], [name() for _ in range(40)] + ["", " "]
    got = keys.allocate_names(spark.createDataFrame(list(enumerate(wishes)), "position int, name string"), spark.createDataFrame([(t,) for t in taken], "name string"))
    assert [r.unique_name for r in got.orderBy("position").collect()] == brute_names(taken, wishes)


def test_verbatim_names(spark):
    new = spark.createDataFrame(list(enumerate(["Rule (2)", "Rule (2)", "rule", "Rule", "Rule"])), "position int, name string")
    got = keys.allocate_names(new, spark.createDataFrame([("RULE",)], "name string"))
    assert [r.unique_name for r in got.orderBy("position").collect()] == ["Rule (2)", "Rule (2) (2)", "rule (3)", "Rule (4)", "Rule (5)"]
    assert keys.allocate_names(new.limit(0), new).count() == 0


def test_a_common_name_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(keys, "_CHUNK", 7)
    wishes = ["a"] * 60 + ["a (30)", "b"] + ["a"] * 20
    got = keys.allocate_names(spark.createDataFrame(list(enumerate(wishes)), "position int, name string"), spark.createDataFrame([("a (5)",), ("a (61)",)], "name string"))
    assert [r.unique_name for r in got.orderBy("position").collect()] == brute_names(["a (5)", "a (61)"], wishes)


def merge(base, more, known):
    """Links after a merge and how many are new."""
    low = {r["name"].strip().lower(): r["id"] for r in known if r["name"].strip()}
    ids = {r["id"] for r in known}
    key = lambda x: tuple((v or "").strip() for v in x[:4])
    base, added = [list(x) for x in base], 0
    for x in more:
        source = (x[0] or "").strip()
        source = source if len(source) == 36 else low.get(source.lower(), source)
        if source not in ids:
            continue
        x = [source, *x[1:]]
        same = [b for b in base if key(b) == key(x)]
        if same:
            if (x[4] or "").strip():
                same[-1][4] = x[4].strip()
        else:
            base.append(x)
            added += 1
    return base, added


def norm(r):
    return (r["name"].strip(), r["kind"].strip().lower())


def brute_default(old, new):
    catalog = [dict(r) for r in old]
    named = {norm(r): i for i, r in enumerate(catalog) if r["name"].strip()}
    at = {r["id"]: i for i, r in enumerate(catalog)}
    content = lambda r: tuple(r[c] for c in CONTENT)
    out = []
    for r in map(dict, new):
        i = named.get(norm(r)) if r["name"].strip() else None
        if i is not None and catalog[i]["m"] != r["m"]:
            catalog[i] = r | {k: catalog[i][k] for k in ("id", "archived", "position")}
            out.append("replace")
        elif r["id"].strip():
            if r["id"] in at:
                j = at[r["id"]]
                catalog[j]["links"], added = merge(catalog[j]["links"], r["links"], old)
                out.append("merge" if added else "duplicate")
            elif any(c["id"] == r["id"] for c in catalog):
                out.append("duplicate")
            else:
                catalog.append(r | {"archived": False})
                out.append("append")
        elif any(content(c) == content(r) for c in catalog):
            out.append("duplicate")
        else:
            catalog.append(r | {"id": r["new_id"], "archived": False})
            out.append("append")
    return out, catalog


def brute_model(old, new):
    catalog = [dict(r) for r in old]
    named = {norm(r): r for r in catalog if r["name"].strip()}
    used, out = {r["name"].strip().lower() for r in catalog}, []
    for r in map(dict, new):
        if not r["id"].strip():
            name, n = r["name"].strip(), 2
            got = name
            while name and got.lower() in used:
                got, n = f"{name} ({n})", n + 1
            used |= {got.lower()} if name else set()
            r |= {"name": got, "archived": False}
            if any(all(c[k] == r[k] for k in CONTENT) for c in catalog):
                out.append(("duplicate", got))
                continue
            catalog.append(r | {"id": r["new_id"]})
            out.append(("create", got))
            continue
        target = next((c for c in catalog if c["id"] == r["id"]), None) or named.get(norm(r))
        if target is None:
            out.append(("skip", r["name"].strip()))
            continue
        target["links"], added = merge(target["links"], r["links"], catalog)
        if added:
            target["archived"] = False
        out.append(("links" if added else "unchanged", r["name"].strip()))
    return out, catalog


def records(rng, n, ids, names, fresh):
    link = lambda: (rng.choice(["1", "2", "A", "b ", "nobody", "n3", "C (2)"]), rng.choice("xy"), rng.choice(["u", " u"]), "S", rng.choice([None, " ", "why", "because"]))
    row = lambda k: {"id": ids(k), "name": rng.choice(names), "kind": rng.choice(["D", "d "]), "m": rng.randrange(2), "purpose": rng.choice("pq"), "archived": rng.random() < 0.5, "links": [link() for _ in range(rng.randrange(3))], "position": k}
    return [row(k) | ({"new_id": f"n{k}"} if fresh else {}) for k in range(n)]


def frame(spark, rows, fresh):
    columns = [*SPEC.replace(f"array<{LINK}>", "").split(","), *(["new_id string"] if fresh else [])]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in columns) for r in rows], SPEC + ", new_id string" * fresh)


def state(rows):
    return [(r["id"], r["name"].strip(), r["kind"], r["m"], r["purpose"], r["archived"], [tuple(x) for x in r["links"]]) for r in rows]


@pytest.mark.parametrize("seed", range(5))
def test_batches_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    old = records(rng, 6, lambda k: str(k), ["A", "B", "C", ""], False)
    new = records(rng, 24, lambda k: rng.choice(["", "", "1", "2", "7", "8"]), ["A", "B", "E", "", "C (2)"], True)
    decided, catalog = generated.merge_generated(frame(spark, old, False), frame(spark, new, True), CONTENT, ["m"])
    want, after = brute_default(old, new)
    assert [r.decision for r in decided.orderBy("position").collect()] == want
    assert state(r.asDict() for r in catalog.orderBy("position").collect()) == state(after)


@pytest.mark.parametrize("seed", range(5))
def test_model_batches_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    old = records(rng, 6, lambda k: str(k), ["A", "B", "C", ""], False)
    new = records(rng, 24, lambda k: rng.choice(["", "", "1", "2", "7", f"n{max(0, k - 2)}"]), ["A", "B", "E", "", "C (2)"], True)
    decided, catalog = generated.merge_model_generated(frame(spark, old, False), frame(spark, new, True), CONTENT)
    want, after = brute_model(old, new)
    assert [(r.decision, r.unique_name) for r in decided.orderBy("position").collect()] == want
    assert state(r.asDict() for r in catalog.orderBy("position").collect()) == state(after)


def test_empty_batches(spark):
    old = frame(spark, records(random.Random(1), 3, str, ["A"], False), False)
    none = frame(spark, [], True)
    for f in (lambda a, b: generated.merge_generated(a, b, CONTENT, ["m"]), lambda a, b: generated.merge_model_generated(a, b, CONTENT)):
        decided, after = f(old, none)
        assert decided.count() == 0 and after.count() == 3
        decided, after = f(old.limit(0), none)
        assert decided.count() == 0 and after.count() == 0

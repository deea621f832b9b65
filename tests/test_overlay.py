import json
import random

import pytest
from fixtures import rows

from fleetcatalog.operators import overlay
from fleetcatalog.operators.manifest import settings_manifest
from fleetcatalog.operators.overlay import inherited_settings, overlay_delta, resolve_settings
from fleetcatalog.store import durable

# A project with two trees of configurations below it, and one that is alone.
SCOPES = [
    ("shop", None, False),
    ("north", "shop", True),
    ("south", "shop", True),
    ("harbour", "north", True),
    ("pier", "harbour", True),
    ("lamp", "pier", True),
    ("beach", "south", True),
    ("probed", "shop", True),
]
SETTINGS = [
    ("shop", "nrOfCpus", "0.5"),
    ("shop", "memory", "96"),
    ("north", "nrOfCpus", "3.0"),
    ("pier", "nrOfCpus", "7.5"),
    ("south", "memory", "128"),
    ("probed", "checks", "$HOST"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    scopes = spark.createDataFrame(SCOPES, "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame(SETTINGS, "scope string, key string, value string")
    return resolve_settings(settings, scopes).cache()


def of(df, target):
    return {r.key: (r.value, r.scope) for r in df.filter(f"target = '{target}'").collect()}


def test_nearest_scope_wins(resolved):
    assert of(resolved, "shop") == {"nrOfCpus": ("0.5", None), "memory": ("96", None)}
    assert of(resolved, "south") == {"nrOfCpus": ("0.5", None), "memory": ("128", "south")}
    assert of(resolved, "harbour") == {"nrOfCpus": ("3.0", "north"), "memory": ("96", None)}
    assert of(resolved, "lamp") == {"nrOfCpus": ("7.5", "pier"), "memory": ("96", None)}


def test_delta(resolved):
    delta = overlay_delta(resolved, full=False)
    assert of(delta, "pier") == {"nrOfCpus": ("7.5", "pier")}
    # Supplied by a parent configuration counts; supplied by the project does not.
    assert of(delta, "beach") == {"memory": ("128", "south")}
    assert of(delta, "shop") == {}
    # Checks alone do not make a delta.
    assert of(delta, "probed") == {}
    assert rows(overlay_delta(resolved, full=True)) == rows(resolved)


def test_circle(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("below", "a"), ("leaf", "below"), ("x", None), ("y", "x")]
    scopes = spark.createDataFrame([(*link, True) for link in links], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame([("x", "k", "v")], "scope string, key string, value string")
    with pytest.raises(ValueError, match="circle: a, b, below, c"):
        inherited_settings(settings, scopes)


def walked(scopes, settings):
    """(target, key, value, scope) by walking up from each scope."""
    above = {s: p for s, p, _ in scopes}
    config = {s for s, _, c in scopes if c}
    own = {(s, k): v for s, k, v in settings if s in above}
    out = []
    for target in above:
        found, at = {}, target
        while at in above:
            for (s, k), v in own.items():
                if s == at:
                    found.setdefault(k, (v, at if at in config else None))
            at = above[at]
        out += [(target, k, *v) for k, v in found.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    scopes = [(f"s{i}", f"s{rng.randrange(max(0, i - 3), i)}" if i and rng.random() < 0.97 else None, rng.random() < 0.8) for i in range(120)]
    scopes += [("stray", "not listed", True), ("below", "stray", True)]
    settings = [(f"s{rng.randrange(130)}", rng.choice("abc"), str(i)) for i in range(60)] + [("stray", "a", "x")]
    settings = list({r[:2]: r for r in settings}.values())
    got = resolve_settings(spark.createDataFrame(settings, "scope string, key string, value string"), spark.createDataFrame(scopes, "scope string, parent string, is_config boolean"))
    assert sorted(((r.target, r.key, r.value, r.scope) for r in got.collect()), key=str) == walked(scopes, settings)


@pytest.mark.parametrize("depth", [2, 65, 5000])
def test_any_depth(spark, monkeypatch, depth):
    """Each round writes rows linear in the scopes, and there are as many rounds as the depth has digits to base two."""
    written = []
    monkeypatch.setattr(overlay, "durable", lambda df: written.append(durable(df)) or written[-1])
    links = [(f"s{i}", f"s{i - 1}" if i else None, i > 0) for i in range(depth)]
    scopes = spark.createDataFrame(links, "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame([("s0", "a", "0"), (f"s{depth // 2}", "b", "half")], "scope string, key string, value string")
    resolved = resolve_settings(settings, scopes)
    found = of(resolved, f"s{depth - 1}")
    assert found["a"] == ("0", None) and found["b"] == ("half", f"s{depth // 2}")
    assert resolved.count() == depth + depth - depth // 2
    assert len(written) <= depth.bit_length() + 1 and all(w.count() <= 3 * depth for w in written)


def test_a_round_writes_a_row_for_each_scope(spark, monkeypatch):
    """Values stand beside their scope's pointer, and scopes at their root are not written again."""
    written = []
    monkeypatch.setattr(overlay, "durable", lambda df: written.append(durable(df)) or written[-1])
    links = [(f"s{i}", f"s{i - 1}" if i else None, i > 0) for i in range(40)]
    scopes = spark.createDataFrame(links, "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame([(f"s{i}", k, str(i)) for i in range(40) for k in "abc"], "scope string, key string, value string")
    assert inherited_settings(settings, scopes).count() == 3 * 39
    # All but the last are parents; a root, and what is found to point at one, are left out afterwards.
    assert [w.count() for w in written] == [39, 38, 37, 35, 31, 23, 7]


@pytest.mark.parametrize("most", [0, 64])
def test_few_and_many_names(spark, monkeypatch, most):
    """Rows by scope and rows by scope and key give the same, with a name and values that are null."""
    monkeypatch.setattr(overlay, "ROW_NAMES", most)
    scopes = spark.createDataFrame([("r", None, False), ("a", "r", True), ("b", "a", True), ("c", "b", True), ("d", "gone", True), ("e", "d", True)], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame([("r", "k", "1"), ("a", "k", None), ("b", None, "2"), ("a", "m", "3"), ("r", "m", "4"), ("d", "k", "5")], "scope string, key string, value string")
    got = {tuple(r) for r in resolve_settings(settings, scopes).collect()}
    assert got == {
        ("r", "k", "1", None), ("r", "m", "4", None), ("a", "k", None, "a"), ("a", "m", "3", "a"), ("b", "k", None, "a"), ("b", "m", "3", "a"), ("b", None, "2", "b"),
        ("c", "k", None, "a"), ("c", "m", "3", "a"), ("c", None, "2", "b"), ("d", "k", "5", "d"), ("e", "k", "5", "d"),
    }
    assert resolve_settings(settings.limit(0), scopes).count() == 0


def test_one_setting_twice(spark):
    scopes = spark.createDataFrame([("s", None, True)], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame([("s", "k", "b", 1), ("s", "k", "a", 2)], "scope string, key string, value string, seq int")
    assert of(resolve_settings(settings, scopes), "s") == {"k": ("a", "s")}
    assert of(resolve_settings(settings.drop("seq"), scopes), "s") == {"k": ("b", "s")}


def test_target_without_name(spark):
    scopes = spark.createDataFrame([("s", None, True), ("bundle-status", None, True)], "scope string, parent string, is_config boolean")
    settings = spark.createDataFrame(
        [("s", "memory", "5"), ("bundle-status", "memory", "6"), ("bundle-status", "checks", '["x"]')], "scope string, key string, value string"
    )
    found = {r.target: json.loads(r.manifest)["components"] for r in settings_manifest(resolve_settings(settings, scopes), full=True).collect()}
    assert found["s"] == {"s": {}}
    assert list(found["bundle-status"]) == ["bundle-status"]
    assert found["bundle-status"]["bundle-status"]["start-command"] == ["check", "--initial-delay", "3", "x"]


def test_manifest_of_settings(spark):
    scopes = spark.createDataFrame(SCOPES, "scope string, parent string, is_config boolean")
    data = [
        *SETTINGS[:-1],
        ("probed", "checks", '["$HOST"]'),
        ("shop", "name", "lamps"),
        ("shop", "tags", '["2.3.1"]'),
        ("shop", "roles", '["sale"]'),
        ("shop", "description", "lamps and oil"),
        ("shop", "endpoints", '{"till":{"bind-protocol":"tcp","bind-port":7,"services":[]}}'),
        ("beach", "checks", '["$HOST"]'),
        ("shop", "checkInitialDelay", "2900"),
    ]
    resolved = resolve_settings(spark.createDataFrame(data, "scope string, key string, value string"), scopes)
    full = {r.target: json.loads(r.manifest) for r in settings_manifest(resolved, full=True).collect()}
    assert full["harbour"] == {
        "version": "1",
        "name": "lamps",
        "tags": ["2.3.1"],
        "nrOfCpus": 3.0,
        "memory": 96,
        "roles": ["sale"],
        "components": {
            "lamps": {
                "description": "lamps and oil",
                "endpoints": {"till": {"bind-protocol": "tcp", "bind-port": 7, "services": []}},
            }
        },
    }
    delta = {r.target: json.loads(r.manifest) for r in settings_manifest(resolved, full=False).collect()}
    assert delta["pier"] == {"version": "1", "nrOfCpus": 7.5, "components": {"lamps": {}}}
    # Checks go along with another setting, with the delay whatever supplies it, but not alone.
    assert delta["beach"]["components"] == {
        "lamps": {},
        "bundle-status": {
            "description": "Status check for the bundle component",
            "file-system-type": "universal",
            "start-command": ["check", "--initial-delay", "2", "$HOST"],
            "endpoints": {},
        },
    }
    assert sorted(delta) == ["beach", "harbour", "lamp", "north", "pier", "south"]

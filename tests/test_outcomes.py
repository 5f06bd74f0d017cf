"""Sets of possible winners, by rule and in whole analyses."""

import itertools
import random

import pytest
from test_analysis import analysed, chart, item

from lodeline.operators import resolution
from lodeline.plans import pipeline

AT = "can://artifact/app/"
SOURCE = "tree string, file string, source string, group string, alternative string"


def folded(sources, definitions, groups):
    """Outcomes by going through the places in order, None for a name that isn't defined."""
    out = {}
    for tree in {s[0] for s in sources}:
        state, broken = {}, False
        files = sorted({s[1] for s in sources if s[0] == tree}, key=lambda f: (f.count("/"), f), reverse=True)
        for f in files:
            here = [s for s in sources if s[:2] == (tree, f)]
            present = {}
            for s in here:
                present.setdefault(s[3], set()).add(s[4])
            missing = None not in present and all(len(a) < groups[tree, g] for g, a in present.items())
            alternatives = []
            for s in here:
                own = {}
                for d in sorted((d for d in definitions if d[:5] == s), key=lambda d: (d[7], d[6])):
                    own.setdefault(d[5], []).append(d)
                broken |= any(sum(not d[8] for d in ds) > 1 for ds in own.values())
                alternatives.append({n: next((d for d in ds if not d[8]), ds[-1]) for n, ds in own.items()})
            for n in {n for a in alternatives for n in a}:
                full = {a[n][6] for a in alternatives if n in a and not a[n][8]}
                empty = {a[n][6] for a in alternatives if n in a and a[n][8]}
                if not missing and all(n in a and not a[n][8] for a in alternatives):
                    state[n] = full
                    continue
                now = state.get(n, {None}) | full
                if None in now:
                    now = now - {None} | empty
                    if missing or any(n not in a for a in alternatives):
                        now.add(None)
                state[n] = now
        if not broken:
            out |= {(tree, n): v for n, v in state.items()}
    return out


def test_sets_follow_without_a_fold(spark):
    rng = random.Random(11)
    sources, definitions, groups = [], [], {}
    for t in range(150):
        tree = f"t{t}"
        for g in ("g1", "g2"):
            groups[tree, g] = rng.randint(2, 3)
        for f, g, a, x in itertools.product(("a", "b", "d/a", "d/e/c"), (None, "g1", "g2"), ("1", "2"), ("x", "y")):
            if rng.random() < 0.2:
                s = (tree, f, x, g, a if g else None)
                if s in sources:
                    continue
                sources.append(s)
                for n, i in itertools.product("mn", range(2)):
                    if rng.random() < (0.5 if i == 0 else 0.04):
                        definitions.append((*s, n, f"{f}{x}{g}{a}{n}{i}", i * 5, rng.random() < 0.4))
    want = folded(sources, definitions, groups)
    df = resolution.possible_winners(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(definitions, f"{SOURCE}, name string, target string, start int, empty boolean"), spark.createDataFrame([(*k, n) for k, n in groups.items()], "tree string, group string, alternatives int"))
    got = {}
    for r in df.collect():
        own = got.setdefault((r.tree, r.name), set())
        own |= ({r.target} if r.target else set()) | ({None} if r.absent else set())
        assert r.outcomes == len(want[r.tree, r.name])
    assert got == want and {len(v) for v in want.values()} >= {1, 2, 3} and sum(None in v for v in want.values()) > 20


def worker(at, a, b, parent="", use='{{ include "shared" . }} {{ include "parent.only" . }}', extra=()):
    files = {
        "Chart.yaml": chart(at, "  - name: worker\n    alias: background\n    version: 1.x\n    repository: file://charts/background\n"),
        "templates/_helpers.tpl": f'{{{{ define "parent.only" }}}}parent{{{{ end }}}}{parent}\n',
        "templates/use.yaml": use,
        "charts/a/Chart.yaml": chart("worker"), "charts/a/templates/_helpers.tpl": a,
        "charts/b/Chart.yaml": chart("worker").replace("1.0.0", "1.1.0"), "charts/b/templates/_helpers.tpl": b,
        "charts/c/Chart.yaml": chart("worker").replace("1.0.0", "9.0.0"), "charts/c/templates/_helpers.tpl": '{{ define "shared" }}c{{ end }}',
    }
    return {f"{at}/{p}": x for p, x in (files | dict(extra)).items()}


DEFINES = ['{{ define "shared" }}x{{ end }}', "# nothing"]
CHOICES = [(0, 0), (0, 1), (1, 0)]


def collisions():
    both = item("one", alias="same", repository="file://x") + item("two", alias="same", repository="file://y")
    return {
        "both/Chart.yaml": chart("both", both), "both/templates/use.yaml": '{{ include "shared" . }}{{ include "only" . }}',
        "both/charts/one/Chart.yaml": chart("one"), "both/charts/one/templates/_h.tpl": DEFINES[0] + '{{ define "only" }}1{{ end }}',
        "both/charts/two/Chart.yaml": chart("two"), "both/charts/two/templates/_h.tpl": DEFINES[0],
    }


@pytest.fixture(scope="module")
def out(spark):
    """Every case as a chart of its own in one workspace."""
    calls, files = '{{ include "parent.only" . }}', collisions()
    for a, b in CHOICES:
        files |= worker(f"open{a}{b}", DEFINES[a], DEFINES[b]) | worker(f"won{a}{b}", DEFINES[a], DEFINES[b], parent='{{ define "shared" }}parent{{ end }}')
    files |= worker("broken", DEFINES[0] * 2, DEFINES[1]) | worker("calls", DEFINES[0], DEFINES[0], extra=[("charts/a/templates/a.yaml", calls), ("charts/b/templates/b.yaml", calls)])
    tables = analysed(spark, files)
    assert not pipeline.violations(tables).take(1)
    return {k: [r for r in tables[k].collect()] for k in ("call_targets", "possible_targets", "outcomes", "diagnostics")}


def of(out, table, at):
    return [r for r in out[table] if (r.artifact_id if table == "diagnostics" else r.tree).startswith(f"{AT}{at}/")]


@pytest.mark.parametrize("a, b", CHOICES)
def test_a_call_that_depends_on_the_choice_has_no_target(out, a, b):
    at = f"open{a}{b}"
    assert {r.name: r.template for r in of(out, "call_targets", at)} == {"shared": None, "parent.only": f"{AT}{at}/templates/_helpers.tpl"}
    possible = {(r.name, r.target.split("/named-template@")[0].removeprefix(f"{AT}{at}/")) for r in of(out, "possible_targets", at)}
    assert possible == {("parent.only", "templates/_helpers.tpl"), *(("shared", f"charts/{x}/templates/_helpers.tpl") for x, i in (("a", a), ("b", b), ("c", 1 - a - b)) if i == 0)}
    # The third one doesn't fit, but is a chart of its own; it loads first.
    assert all(not r.absent and r.outcomes == 2 for r in of(out, "possible_targets", at) if r.name == "shared")
    assert {r.code for r in of(out, "diagnostics", at)} == {"IAC_HELM_AMBIGUOUS_VENDORED_DEPENDENCY", "IAC_HELM_AMBIGUOUS_TEMPLATE_TARGET"}


@pytest.mark.parametrize("a, b", CHOICES)
def test_the_parent_wins_whatever_is_chosen(out, a, b):
    at = f"won{a}{b}"
    assert {r.name: r.template for r in of(out, "call_targets", at)} == dict.fromkeys(("shared", "parent.only"), f"{AT}{at}/templates/_helpers.tpl")
    assert "IAC_HELM_AMBIGUOUS_TEMPLATE_TARGET" not in {r.code for r in of(out, "diagnostics", at)}


def test_a_choice_that_breaks_the_tree_leaves_it_without_winners(out):
    assert {r.template for r in of(out, "call_targets", "broken")} == {None} and not of(out, "outcomes", "broken")


def test_calls_of_possible_charts_have_no_target(out):
    found = {r.artifact_id.removeprefix(f"{AT}calls/"): r.template for r in of(out, "call_targets", "calls") if r.name == "parent.only"}
    assert found == {"templates/use.yaml": f"{AT}calls/templates/_helpers.tpl", "charts/a/templates/a.yaml": None, "charts/b/templates/b.yaml": None}


def test_a_place_with_two_files_is_open_by_name(out):
    assert {(r.name, r.template) for r in of(out, "call_targets", "both")} == {("shared", None), ("only", None)}
    assert {(r.name, r.outcomes, r.absent) for r in of(out, "outcomes", "both")} == {("shared", 2, False), ("only", 2, True)}
    assert sum(r.code == "IAC_HELM_AMBIGUOUS_TEMPLATE_TARGET" for r in of(out, "diagnostics", "both")) == 3

"""Documents inside template files."""

import re

import pytest

from lodeline.operators import regions

COMMENT = "{{/*\n---\n*/}}"
CASES = {
    "one": ("a: 1\n", ["a: 1\n"]),
    "two": ("a: 1\n---\nb: 2\n", ["a: 1\n", "b: 2\n"]),
    "dots and a sign": ("a: 1\n... # end {{ .x }}\nb: 2\r\n--- \nc: 3", ["a: 1\n", "b: 2\r\n", "c: 3"]),
    "no separators": ("a: 1\n--- b\n ---\n----\n---{{ x }}\n--- {{ x }}\n", ["a: 1\n--- b\n ---\n----\n---{{ x }}\n--- {{ x }}\n"]),
    "in a comment and in a definition": (f'a: 1\n{COMMENT}\n{{{{ define "x" }}}}\n---\n{{{{ end }}}}\nb: 2\n', [f'a: 1\n{COMMENT}\n{{{{ define "x" }}}}\n---\n{{{{ end }}}}\nb: 2\n']),
    "in an action": ('{{ include "x" (dict\n---\n) }}\n', ['{{ include "x" (dict\n---\n) }}\n']),
    "definitions around": ('{{ define "x" }}1{{ end }}\n{{ define "y" }}2{{ end }}\na: ä\n{{ define "z" }}3{{ end }}\n', ['\na: ä\n']),
    "definitions that trim": ('\n {{- define "x" }}1{{ end -}} \n\na: 1\n---\n\n{{- define "y" }}2{{ end -}}\n\nb: 2', ["a: 1\n", "b: 2"]),
    "definition in the middle": ('a: 1\n{{ define "x" }}1{{ end }}\nb: 2\n', ['a: 1\n{{ define "x" }}1{{ end }}\nb: 2\n']),
    "nothing said": (f'# c\n---\n{{{{ if .x }}}}\n{{{{- else }}}} \n{{{{ end }}}}\n---\n{COMMENT}\n---\n{{{{ define "x" }}}}1{{{{ end }}}}\n---\n  \n', []),
    "written by an action": ('{{ if .x }}{{ toYaml . }}{{ end }}\n---\n# {{ .x }}\n', ['{{ if .x }}{{ toYaml . }}{{ end }}\n']),
    "nested blocks in a definition": ('{{ define "x" }}{{ if 1 }}{{ range . }}a{{ end }}{{ end }}\n---\n{{ end }}\nb: 1\n---\nc: 1', ["\nb: 1\n", "c: 1"]),
    "empty": ("", []),
    "long": ("日本: 1\n---\n" * 3000, ["日本: 1\n"] * 3000),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "artifact_id string, source string")
    return regions.template_regions(df).orderBy("artifact_id", "nth").collect()


@pytest.mark.parametrize("name", CASES)
def test_regions(found, name):
    source, want = CASES[name]
    own = [r for r in found if r.artifact_id == name]
    assert [source.encode()[r.start : r.stop].decode() for r in own] == want
    assert [r.nth for r in own] == list(range(len(want)))
    for r in own:
        said = source.encode()[: r.stop].decode().split("\n")[r.first_line - 1]
        assert said.strip() and not said.strip().startswith("#")


def test_pieces_have_places_in_bytes(spark):
    source = 'ä\n{{ define "x" }}\né{{/* c */}}{{ end }}\n{{ .y }}'
    rows = regions.template_pieces(spark.createDataFrame([("a", source)], "artifact_id string, source string")).orderBy("piece").collect()
    assert b"".join(source.encode()[r.start : r.stop] for r in rows) == source.encode() and [r.text for r in rows] == re.findall(r"(?s)\{\{.*?\}\}|(?:(?!\{\{).)+", source)
    assert [(r.kind, r.defining, r.line) for r in rows if r.token] == [("define", True, 2), ("comment", True, 3), ("end", True, 3), (None, False, 4)]

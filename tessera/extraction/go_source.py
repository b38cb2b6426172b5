"""Go files."""

from __future__ import annotations

import posixpath as pp

from tessera.extraction.lexer import BadSource, Call, Decl, Parsed, Site, Tokens, innermost
from tessera.extraction.shared import prefixes

NOT_CALLED = {"func", "if", "for", "switch", "return", "go", "defer", "select", "range", "case", "interface", "struct", "map", "chan"}


def parse(path: str, text: str, project_dir: str | None, project_name: str | None) -> Parsed:
    t = Tokens(text, "go")
    out, alias = Parsed(provides=[f"f:{path}"]), {}
    if not path.endswith("_test.go"):
        out.provides.append("d:" + (pp.dirname(path) or "."))
    if t.text(0) != "package":
        raise BadSource("package clause")

    def add(name, kind, a, b, line=None):
        out.decls.append(Decl(name, kind, t.t[a].line, t.t[min(b, len(t)) - 1].end, "A" <= name[:1] <= "Z", lo=a, hi=b))

    def include(i):
        spec, name = t.t[i].text[1:-1], t.text(i - 1) if t.is_id(i - 1) and t.text(i - 1) != "import" else None
        keys, ext = [], []
        if project_name and (spec == project_name or spec.startswith(project_name + "/")):
            keys = [(0, "d:" + pp.normpath(pp.join(project_dir or ".", spec[len(project_name) :].strip("/"))))]
        elif project_name:
            ext = prefixes(spec, "/")
        if project_name and name not in ("_", "."):
            alias[name or spec.split("/")[-1]] = [len(out.imports)]
        out.imports.append(Site(spec, t.t[i].line, t.t[i].end, keys, ext))

    def spec_names(i, end, kind):
        """Names of const, var or type entries between i and end, each on a line of its own."""
        while i < end:
            line = t.t[i].line
            if t.is_id(i):
                if kind == "type":
                    j = i + 1
                    if t.text(j) == "[" and t.is_id(j + 1) and t.text(t.after(j)) not in ("", ";") and t.t[t.after(j)].line == line:
                        j = t.after(j)
                    stop = j
                    while stop < end and t.t[stop].line == t.t[stop - 1].end:
                        stop = t.after(stop)
                    what = {"interface": "interface"}.get(t.text(j), "type")
                    add(t.text(i), what, i, min(stop, end))
                    i = stop
                    continue
                while True:
                    add(t.text(i), "const", i, i + 1)
                    if t.text(i + 1) == "," and t.is_id(i + 2):
                        i += 2
                    else:
                        break
            i = t.after(i)
            while i < end and t.t[i].line == t.t[i - 1].end and t.text(i) != ";":
                i = t.after(i)
            if t.text(i) == ";":
                i += 1

    i = 2
    while i < len(t):
        word = t.text(i)
        if word == "import":
            if t.text(i + 1) == "(":
                for j in range(i + 2, t.match[i + 1]):
                    if t.t[j].kind == "str":
                        include(j)
                i = t.after(i + 1)
            else:
                j = i + 1 if t.t[i + 1].kind == "str" else i + 2
                include(j)
                i = j + 1
        elif word == "func":
            method = t.text(i + 1) == "("
            n = t.after(i + 1) if method else i + 1
            j = t.after(n + 1) if t.text(n + 1) == "[" else n + 1
            j = t.after(j)  # parameters
            while j < len(t) and t.text(j) != "{" and t.t[j].line == t.t[j - 1].end:
                j = t.after(j + 1) if t.text(j) in ("interface", "struct") else t.after(j)
            end = t.after(j) if t.text(j) == "{" and t.t[j].line == t.t[j - 1].end else j
            add(t.text(n), "method" if method else "function", i, end)
            i = end
        elif word in ("const", "var", "type"):
            if t.text(i + 1) == "(":
                spec_names(i + 2, t.match[i + 1], word)
                i = t.after(i + 1)
            else:
                j = t.after(i + 1)
                while j < len(t) and (t.t[j].line == t.t[j - 1].end):
                    j = t.after(j)
                spec_names(i + 1, j, word)
                i = j
        else:
            i = t.after(i)
    for i in range(len(t)):
        if not (t.is_id(i) and t.text(i + 1) == "(") or t.text(i) in NOT_CALLED or t.text(i - 1) == "func":
            continue
        caller = innermost(out.decls, i)
        if caller < 0 or (out.decls[caller].kind == "method" and t.match.get(i - 1) == out.decls[caller].lo + 1) or out.decls[caller].kind == "interface":
            continue
        start, end = t.t[t.chain_start(i)].line, t.t[t.match[i + 1]].end
        if t.text(i - 1) != ".":
            out.calls.append(Call(caller, t.text(i), "function", start, end))
        elif t.is_id(i - 2) and t.text(i - 3) != "." and t.text(i - 2) in alias:
            out.calls.append(Call(caller, t.text(i), "function", start, end, via=alias[t.text(i - 2)], strict=True))
        else:
            out.calls.append(Call(caller, t.text(i), "method", start, end))
    return out

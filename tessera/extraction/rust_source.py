"""Rust files: items of inline modules too; use trees flattened."""

from __future__ import annotations

import posixpath as pp

from tessera.extraction.lexer import Call, Decl, Parsed, Site, Tokens, innermost

NOT_CALLED = {"if", "while", "for", "match", "return", "loop", "fn", "in", "let", "move", "Some", "Ok", "Err", "pub"}
KIND = {"struct": "type", "enum": "enum", "trait": "interface", "const": "const", "static": "const", "type": "type", "union": "type"}


def parse(path: str, text: str, project_dir: str | None, project_name: str | None) -> Parsed:
    t = Tokens(text, "rust")
    out, alias, mods, uses = Parsed(provides=[f"f:{path}"]), {}, [], []
    root = pp.normpath(pp.join(project_dir or ".", "src"))
    stem = pp.basename(path)
    here = pp.dirname(path) if stem in ("lib.rs", "main.rs", "mod.rs") else path[:-3]

    def flatten(i, end, head):
        """(segments) of a use tree between tokens i and end."""
        while i < end:
            seg, got = list(head), None
            while i < end and t.text(i) != ",":
                if t.text(i) == "{":
                    got = list(flatten(i + 1, t.match[i], seg))
                    i = t.after(i)
                elif t.text(i) == "as":
                    i += 2
                elif t.text(i) == "::":
                    i += 1
                else:
                    seg = seg + [t.text(i)]
                    i += 1
            yield from got if got is not None else [seg]
            i += 1

    def tries(base, seg):
        return [pp.join(base, *seg) + ".rs", pp.join(base, *seg, "mod.rs")] if seg else []

    def use(i, end, test):
        for seg in flatten(i + 1, end, []):
            spec, tail = "::".join(seg), seg[1:]
            if tail and tail[-1] in ("*", "self"):
                tail = tail[:-1]
            keys, ext = [], []
            if seg[0] in ("crate", "self"):
                base = root if seg[0] == "crate" else here
                paths = tries(base, tail) + tries(base, tail[:-1]) + ([path] if seg[0] == "self" else [])
                keys = [(k, "f:" + pp.normpath(p)) for k, p in enumerate(paths)]
            elif seg[0] != "super":
                ext = [(0, seg[0].replace("-", "_"))]
            site = Site(spec, t.t[i].line, t.t[end].end, keys, ext, test=test)
            uses.append((site, (tail or seg)[-1]))

    def items(i, end, test, owner=None):
        start, exported, marked, word_at = i, False, False, None
        while i < end:
            word = t.text(i)
            if word == "#" and t.text(i + 1) in ("[", "!"):
                j = i + 1 if t.text(i + 1) == "[" else i + 2
                inside = [t.text(k) for k in range(j + 1, t.match[j])]
                marked = marked or inside == ["test"] or (inside[:1] == ["cfg"] and "test" in inside)
                i = t.after(j)
                start = i if word_at is None else start
                continue
            if word == "pub":
                exported, word_at = True, i
                i = t.after(i + 1) if t.text(i + 1) == "(" else i + 1
                continue
            if word in ("unsafe", "async", "extern", "default") or t.t[i].kind == "str" or (word == "const" and t.text(i + 1) in ("fn", "unsafe", "async")):
                if word == "extern" and t.text(i + 1) == "crate":
                    j = t.find(i, {";"})
                    uses.append((Site(t.text(i + 2), t.t[i].line, t.t[j].end, [], [(0, t.text(i + 2).replace("-", "_"))], test=test or marked), t.text(i + 2)))
                    i = j
                else:
                    i += 1
                    continue
            elif word == "use":
                j = t.find(i, {";"})
                use(i, j, test or marked)
                i = j
            elif word == "mod":
                if t.text(i + 2) == ";":
                    mods.append((Site(t.text(i + 1), t.t[start].line, t.t[i + 2].end, [(k, "f:" + pp.normpath(p)) for k, p in enumerate(tries(here, [t.text(i + 1)]))], test=test or marked), t.text(i + 1)))
                    i += 2
                else:
                    items(i + 3, t.match[i + 2], test or marked)
                    i = t.match[i + 2]
            elif word == "fn":
                j = t.find(t.angle(i + 2), {"{", ";"})
                stop = t.after(j)
                out.decls.append(Decl(t.text(i + 1), "method" if owner else "function", t.t[start].line, t.t[stop - 1].end, exported, owner, test or marked, start, stop))
                i = stop - 1
            elif word == "impl":
                j = t.find(t.angle(i + 1), {"{"})
                k, of, depth = t.angle(i + 1), None, 0
                while k < j and t.text(k) != "where":
                    if t.text(k) == "for":
                        of = None
                    elif t.is_id(k) and depth == 0 and t.text(k) not in ("dyn", "mut"):
                        of = t.text(k)
                    k = t.angle(k) if t.text(k) == "<" else t.after(k)
                items(j + 1, t.match[j], test or marked, of or "impl")
                i = t.match[j]
            elif word in KIND and t.is_id(i + 1):
                j = t.find(i + 2, {"{", ";"}) if word not in ("const", "static", "type") else t.find(i + 2, {";"})
                stop = t.after(j) if j >= 0 else i + 2
                if not owner:
                    out.decls.append(Decl(t.text(i + 1), KIND[word], t.t[start].line, t.t[stop - 1].end, exported, None, test or marked, start, stop))
                i = stop - 1
            else:
                i = t.after(i) - 1
            i += 1
            start, exported, marked, word_at = i, False, False, None

    items(0, len(t), False)
    for site, name in uses + mods:
        alias.setdefault(name, []).append(len(out.imports))
        out.imports.append(site)
    for i in range(len(t)):
        if not (t.is_id(i) and t.text(i + 1) == "(") or t.text(i) in NOT_CALLED or t.text(i - 1) == "fn":
            continue
        caller = innermost(out.decls, i)
        if caller < 0:
            continue
        start, end = t.t[t.chain_start(i)].line, t.t[t.match[i + 1]].end
        if t.text(i - 1) == "::":
            q = t.text(i - 2)
            if q == "Self":
                q = out.decls[caller].owner or q
            if t.is_id(i - 2):
                out.calls.append(Call(caller, t.text(i), "either", start, end, owner=q, via=alias.get(q, []), strict=True))
        else:
            out.calls.append(Call(caller, t.text(i), "method" if t.text(i - 1) == "." else "function", start, end))
    return out

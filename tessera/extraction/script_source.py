"""TypeScript and JavaScript files: top-level declarations, direct class methods, imports and named re-exports."""

from __future__ import annotations

import posixpath as pp

from tessera.extraction.lexer import BadSource, Call, Decl, Parsed, Site, Tokens, innermost

NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "new", "with", "constructor", "require", "async", "void", "yield", "delete", "of", "in", "case", "throw"}
ENDINGS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"]
MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "abstract", "declare"}
JOINERS = {"=", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", ",", ".", "?.", "=>", "<", "(", "[", "!", "extends", "as", "satisfies", "in", "of", "instanceof", "new", "await", "typeof", "keyof"}


def candidates(base: str) -> list[str]:
    head, ext = pp.splitext(base)
    swap = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx"], ".mjs": [], ".cjs": []}.get(ext, [])
    exact = [base] if ext in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs") else []
    return [head + e for e in swap] + exact + [base + e for e in ENDINGS] + [pp.join(base, "index" + e) for e in ENDINGS]


def aliased(spec: str, aliases: list[tuple[str, list[str]]]) -> list[str]:
    """Where an alias leads: the pattern that is the name itself, else the one with the longest text before its star."""
    best, length = [], -1
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        if not star:
            if spec == pattern:
                return targets
        elif len(head) > length and len(spec) >= len(head) + len(tail) and spec.startswith(head) and spec.endswith(tail):
            middle = spec[len(head) : len(spec) - len(tail)]
            best, length = [pp.normpath(t.replace("*", middle, 1)) for t in targets], len(head)
    return best


def package_of(spec: str) -> str:
    return "/".join(spec.split("/")[: 2 if spec.startswith("@") else 1])


def parse(path: str, text: str, project_dir: str | None, project_name: str | None, aliases: list[tuple[str, list[str]]] = ()) -> Parsed:
    t = Tokens(text, "script")
    out, alias, heads, quiet, concrete = Parsed(provides=[f"f:{path}"]), {}, set(), [], set()

    def statement_end(i):
        """Past the statement that holds token i: at a semicolon or a line break that nothing joins."""
        while i < len(t):
            if t.text(i) == ";":
                return i + 1
            if t.text(i) in ("}", ")", "]"):
                return i
            nxt = t.after(i)
            if nxt < len(t) and t.t[nxt].line > t.t[nxt - 1].end and t.text(i) not in JOINERS and t.text(nxt) not in JOINERS - {"[", "(", "new", "await", "typeof", "keyof"}:
                return nxt
            i = nxt
        return i

    def source(spec, a, b, re_export=False, edge=True):
        spec = spec[1:-1]
        local = spec.startswith((".", "/"))
        bases = [pp.normpath(pp.join(pp.dirname(path), spec))] if local else aliased(spec, aliases)
        found = [p for base in bases for p in candidates(base)]
        keys = [(k - len(found), "f:" + p) for k, p in enumerate(found)]  # below 0: before a package of the workspace
        out.imports.append(Site(spec, t.t[a].line, t.t[b].end, keys, [] if local else [(0, package_of(spec)), (1, "@types/" + package_of(spec).lstrip("@").replace("/", "__"))], re_export, edge))
        return len(out.imports) - 1

    def specifiers(i):
        """(outer name, local name) in the braces at i."""
        got, k = [], i + 1
        while k < t.match[i]:
            if t.text(k) == "type" and t.is_id(k + 1) and t.text(k + 1) != "as":
                k += 1
            a = t.text(k)
            b = t.text(k + 2) if t.text(k + 1) == "as" else a
            got.append((a, b))
            k = t.find(k, {","})
            if k < 0:
                break
            k += 1
        return got

    def body_end(i):
        """Past the body of a function whose parameters begin at or after i; (end, has body)."""
        while t.text(i) not in ("(", ""):
            i = t.angle(i) if t.text(i) == "<" else i + 1
        if not t.text(i):
            raise BadSource("parameters")
        i = t.after(i)
        if t.text(i) == ":":
            i += 1
            while i < len(t) and t.text(i) not in (";", "}", ")"):
                if t.text(i) == "{" and (t.text(i - 1) not in (":", "|", "&", "=>", "<", ",")):
                    return t.after(i), True
                nxt = t.angle(i) if t.text(i) == "<" else t.after(i)
                if nxt < len(t) and t.t[nxt].line > t.t[nxt - 1].end and t.text(nxt) not in ("|", "&", "{", "=>") and t.text(i) not in JOINERS:
                    return nxt, False
                i = nxt
        if t.text(i) == "{":
            return t.after(i), True
        return (i + 1 if t.text(i) == ";" else i), False

    def methods(open_, exported, owner):
        end = t.match[open_]
        i = start = open_ + 1
        while i < end:
            word = t.text(i)
            mods = {t.text(k) for k in range(start, i)}
            if word in ("get", "set") and t.text(i + 1) not in ("(", "<", "=", ":", ";"):
                i = start = body_end(i + 2)[0]
            elif word in MODIFIERS and t.text(i + 1) not in ("(", "<", "=", ":", ";", "?") or word == "*":
                i += 1
            elif t.is_id(i) and word.startswith("@"):
                i = t.after(i + 1) if t.text(i + 1) == "(" else i + 1
            elif t.is_id(i) and (t.text(i + 1) in ("(", "<") or t.text(i + 1) == "?" and t.text(i + 2) in ("(", "<")):
                stop, has = body_end(i + 1)
                heads.add(i)
                if word != "constructor" and not word.startswith("#") and (has or "abstract" in mods):
                    out.decls.append(Decl(word, "method", t.t[start].line, t.t[stop - 1].end, exported, owner, lo=start, hi=stop))
                    if has:
                        concrete.add((owner, word))
                i = start = stop
            elif word in (";", ","):
                i = start = i + 1
            else:
                i = start = max(statement_end(i), i + 1)

    def arrow(i):
        """Whether an initialiser that begins at i is a function."""
        i += t.text(i) == "async"
        if t.text(i) == "function":
            return True
        i = t.angle(i) if t.text(i) == "<" else i
        if t.text(i) == "(":
            j = t.after(i)
            if t.text(j) == ":":
                j = t.find(j, {"=>"}, {";"})
            return t.text(j) == "=>"
        return t.is_id(i) and t.text(i + 1) == "=>"

    i = 0
    while i < len(t):
        start, exported, default = i, False, False
        while t.text(i) in ("export", "default", "declare", "abstract", "async") or (t.is_id(i) and t.text(i).startswith("@")):
            if t.text(i).startswith("@"):
                i = t.after(i + 1) if t.text(i + 1) == "(" else i + 1
                continue
            exported = exported or t.text(i) == "export"
            default = default or t.text(i) == "default"
            i += 1
        word = t.text(i)
        if word == "import" and t.text(i + 1) not in ("(", "."):
            end = statement_end(i)
            spec = next((k for k in range(end - 1, i, -1) if t.t[k].kind == "str"), None)
            if spec is None:
                raise BadSource("import")
            n = source(t.t[spec].text, i, end - 1)
            k = i + 1
            if t.text(k) == "type" and t.text(k + 1) != "from":
                k += 1
            while k < spec and t.text(k) != "from":
                if t.text(k) == "{":
                    alias |= {b: (n, a) for a, b in specifiers(k)}
                elif t.text(k) == "*":
                    alias[t.text(k + 2)] = (n, "*")
                    k += 2
                elif t.is_id(k):
                    alias[t.text(k)] = (n, "default")
                k = t.after(k)
            i = end
        elif exported and not default and (word in ("*", "{") or word == "type" and t.text(i + 1) in ("*", "{")):
            i += word == "type"
            end = statement_end(i)
            spec = next((k for k in range(end - 1, t.after(i) - 1, -1) if t.t[k].kind == "str"), None)
            if t.text(i) == "*":
                n = source(t.t[spec].text, start, end - 1, edge=False)
                if t.text(i + 1) != "as":
                    out.links.append(("*", n, "*"))
            elif spec is not None:
                n = source(t.t[spec].text, start, end - 1, re_export=True)
                out.links += [(b, n, a) for a, b in specifiers(i)]
            else:
                for a, b in specifiers(i):
                    if a in alias:
                        out.links.append((b, *alias[a]))
                    for d in out.decls:
                        if d.name == a and d.owner is None:
                            d.exported = True
                    if a != b and a not in alias:
                        out.links.append((b, -1, a))
            i = end
        elif word == "function":
            k = i + 1 + (t.text(i + 1) == "*")
            name = t.text(k) if t.is_id(k) else "default"
            stop, has = body_end(k)
            heads.add(k)
            if has or t.text(start) == "declare":
                out.decls.append(Decl(name, "function", t.t[start].line, t.t[stop - 1].end, exported, lo=start, hi=stop))
                if default and name != "default":
                    out.links.append(("default", -1, name))
            i = stop
        elif word in ("class", "interface") and (t.is_id(i + 1) or t.text(i + 1) == "{"):
            name = t.text(i + 1) if t.is_id(i + 1) and t.text(i + 1) not in ("extends", "implements") else "default"
            open_ = t.find(t.angle(i + 2) if name != "default" else i + 1, {"{"})
            if open_ < 0:
                raise BadSource(word)
            stop = t.after(open_)
            out.decls.append(Decl(name, word, t.t[start].line, t.t[stop - 1].end, exported, lo=start, hi=stop))
            if default and name != "default":
                out.links.append(("default", -1, name))
            if word == "class":
                methods(open_, exported, name)
            else:
                quiet.append((open_, stop))
            i = stop
        elif word == "enum" or word == "const" and t.text(i + 1) == "enum":
            k = i + 1 + (word == "const")
            stop = t.after(k + 1)
            out.decls.append(Decl(t.text(k), "enum", t.t[start].line, t.t[stop - 1].end, exported, lo=start, hi=stop))
            i = stop
        elif word == "type" and t.is_id(i + 1) and t.text(i + 2) in ("=", "<"):
            stop = statement_end(t.angle(i + 2))
            out.decls.append(Decl(t.text(i + 1), "type", t.t[start].line, t.t[stop - 1].end, exported, lo=start, hi=stop))
            quiet.append((i, stop))
            i = stop
        elif word == "const":
            stop, k = statement_end(i + 1), i + 1
            while 0 <= k < stop:
                eq = t.find(k, {"="}, {";"})
                nxt = t.find(k, {","}, {";"})
                nxt = nxt if 0 <= nxt < stop else stop
                if t.is_id(k):
                    out.decls.append(Decl(t.text(k), "function" if 0 <= eq < stop and arrow(eq + 1) else "const", t.t[k].line, t.t[nxt - 1].end, exported, lo=k, hi=nxt))
                k = nxt + 1
            i = stop
        elif default:
            stop = statement_end(i)
            if t.is_id(i) and t.text(i) in alias:
                out.links.append(("default", *alias[t.text(i)]))
            elif t.is_id(i):
                out.links.append(("default", -1, t.text(i)))
            i = max(stop, i + 1)
        else:
            i = max(statement_end(i), i + 1)
    for i in range(len(t)):
        if not t.is_id(i) or t.text(i) in NOT_CALLED or i in heads or t.text(i)[0] in "@#":
            continue
        k = i + 1 + (t.text(i + 1) == "?.")
        k = t.angle(k) if t.text(k) == "<" and t.text(t.angle(k)) == "(" else k
        if t.text(k) != "(" or t.text(i - 1) in ("function", "new") or any(a <= i < b for a, b in quiet):
            continue
        close = t.match[k]
        if t.text(close + 1) in ("{", "=>") and t.text(i - 1) not in (".", "?."):
            continue
        caller = innermost(out.decls, i)
        first = t.chain_start(i)
        if caller < 0 or t.text(first - 1) == "new" and first == i:
            continue
        a, b = t.t[first].line, t.t[close].end
        if t.text(i - 1) in (".", "?."):
            q = t.text(i - 2) if t.is_id(i - 2) and first == i - 2 else ""
            if q in alias and alias[q][1] == "*":
                out.calls.append(Call(caller, t.text(i), "function", a, b, via=[alias[q][0]], strict=True))
            elif q in alias:
                out.calls.append(Call(caller, t.text(i), "method", a, b, owner=alias[q][1], via=[alias[q][0]]))
            elif (of := (out.decls[caller].owner or out.decls[caller].name) if q == "this" else q, t.text(i)) in concrete:
                out.calls.append(Call(caller, t.text(i), "method", a, b, owner=of, own=True, strict=True))
            else:
                out.calls.append(Call(caller, t.text(i), "method", a, b))
        elif t.text(i) in alias:
            out.calls.append(Call(caller, alias[t.text(i)][1], "function", a, b, via=[alias[t.text(i)][0]], strict=True))
        else:
            out.calls.append(Call(caller, t.text(i), "function", a, b, own=True, strict=True))
    return out

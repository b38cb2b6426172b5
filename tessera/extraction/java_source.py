"""Java files: top-level types and their direct methods and constructors."""

from __future__ import annotations

from tessera.extraction.lexer import Call, Decl, Parsed, Site, Tokens, innermost
from tessera.extraction.shared import prefixes

NOT_CALLED = {"if", "for", "while", "switch", "catch", "synchronized", "super", "this", "return", "try", "new", "assert", "throw"}


def parse(path: str, text: str, project_dir: str | None, project_name: str | None) -> Parsed:
    t = Tokens(text, "java")
    out, package, visible, heads = Parsed(provides=[f"f:{path}"]), "", {}, set()

    def dotted(i):
        name = ""
        while t.is_id(i) or t.text(i) in (".", "*"):
            name, i = name + t.text(i), i + 1
        return name, i

    i = start = 0
    while i < len(t):
        word = t.text(i)
        if word == "package":
            package, i = dotted(i + 1)
            out.provides.append("p:" + package)
            start = i + 1
        elif word == "import":
            first, static = i, t.text(i + 1) == "static"
            name, i = dotted(i + 1 + static)
            kind = name.rsplit(".", 1)[0] if static else name
            keys = [(0, "p:" + name[:-2])] if name.endswith(".*") and not static else [(0, "c:" + kind)]
            visible.setdefault(kind.rsplit(".", 1)[-1], []).append(len(out.imports))
            out.imports.append(Site(name, t.t[first].line, t.t[min(i, len(t) - 1)].end, keys, prefixes(name, ".")))
            start = i + 1
        elif word in ("class", "interface", "enum") and t.text(i - 1) != "." and t.is_id(i + 1):
            name, line = t.text(i + 1), t.t[start].line
            open_ = t.find(i + 2, {"{"})
            if open_ < 0:
                break
            end = t.after(open_)
            mods = {t.text(k) for k in range(start, i)}
            out.decls.append(Decl(name, word, line, t.t[end - 1].end, "public" in mods, lo=start, hi=end))
            out.provides.append("c:" + (f"{package}.{name}" if package else name))
            heritage = False
            j = t.angle(i + 2)
            while j < open_:
                if t.text(j) in ("extends", "implements", "permits"):
                    heritage = t.text(j) != "permits"
                elif heritage and t.is_id(j) and t.text(j - 1) != "." and t.text(j) not in visible:
                    base = t.text(j)
                    out.imports.append(Site(base, t.t[j].line, t.t[j].end, [(0, "c:" + (f"{package}.{base}" if package else base))]))
                j = t.angle(j) if t.text(j) == "<" else t.after(j)
            members(t, out, heads, open_, name)
            i = start = end
        elif word == ";":
            i += 1
            start = i
        else:
            i = t.after(i)
    for i in range(len(t)):
        if not (t.is_id(i) and t.text(i + 1) == "(") or i in heads or t.text(i) in NOT_CALLED or t.text(i - 1) in ("new", "@"):
            continue
        caller = innermost(out.decls, i)
        close = t.match[i + 1]
        if caller < 0 or t.text(i).startswith("@") or (t.text(close + 1) in ("{", "throws") and t.text(i - 1) != "->"):
            continue
        first = t.chain_start(i)
        if t.text(first - 1) == "new":
            first -= 1
        got = Call(caller, t.text(i), "method", t.t[first].line, t.t[close].end)
        if t.text(i - 1) == "." and t.is_id(i - 2) and t.text(i - 3) != "." and t.text(i - 2) not in ("this", "super"):
            got.owner, got.via = t.text(i - 2), visible.get(t.text(i - 2), [])
        out.calls.append(got)
    return out


def members(t: Tokens, out: Parsed, heads: set, open_: int, owner: str) -> None:
    end = t.match[open_]
    i = start = open_ + 1
    while i < end:
        word = t.text(i)
        if word in (";", "}"):
            i += 1
            start = i
        elif word == "{" or word in ("class", "interface", "enum", "record") and t.is_id(i + 1) and t.text(i - 1) != ".":
            j = i if word == "{" else t.find(i, {"{"})
            i = start = t.after(j) if j >= 0 else i + 1
        elif word == "=":
            j = t.find(i, {";"})
            i = start = j + 1 if j >= 0 else end
        elif word == "@" or word.startswith("@"):
            i += 1 if word != "@" else 2
            while t.text(i) == ".":
                i += 2
            i = t.after(i) if t.text(i) == "(" else i
        elif t.is_id(i) and t.text(i + 1) == "(" and (t.text(i) == owner or (i > start and (t.is_id(i - 1) or t.text(i - 1) in (">", "]")))):
            j = t.find(t.after(i + 1), {"{", ";"})
            stop = end if j < 0 else t.after(j)
            mods = {t.text(k) for k in range(start, i)}
            out.decls.append(Decl(t.text(i), "method", t.t[start].line, t.t[stop - 1].end, "public" in mods, owner, lo=start, hi=stop))
            heads.add(i)
            i = start = stop
        else:
            i = t.after(i)

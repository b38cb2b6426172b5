"""Python files by the standard syntax tree."""

from __future__ import annotations

import ast
import posixpath as pp
import warnings

from tessera.extraction.lexer import BadSource, Call, Decl, Parsed, Site
from tessera.extraction.shared import normal


def parse(path: str, text: str, project_dir: str | None, project_name: str | None) -> Parsed:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        raise BadSource(str(e)) from e
    out, owner_of = Parsed(provides=[f"f:{path}"]), {}

    def declare(node, name, kind, owner=None):
        owner_of[id(node)] = len(out.decls)
        out.decls.append(Decl(name, kind, node.lineno, node.end_lineno, not name.startswith("_"), owner))

    def body(nodes, owner=None):
        for n in nodes:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                declare(n, n.name, "method" if owner else "function", owner)
            elif isinstance(n, ast.ClassDef):
                declare(n, n.name, "class", owner)
                body(n.body, n.name)
            elif not owner and isinstance(n, ast.Assign | ast.AnnAssign):
                for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for x in target.elts if isinstance(target, ast.Tuple | ast.List) else [target]:
                        if isinstance(x, ast.Name):
                            declare(n, x.id, "const")

    body(tree.body)
    alias: dict[str, list[int]] = {}
    for n in sorted((x for x in ast.walk(tree) if isinstance(x, ast.Import | ast.ImportFrom)), key=lambda x: (x.lineno, x.col_offset)):
        for a in n.names:
            if isinstance(n, ast.Import):
                parts, level, tries, bound = a.name.split("."), 0, [a.name.split(".")], a.asname or a.name.split(".")[0]
                whole, spec = a.asname or "." not in a.name, a.name
            else:
                parts, level = (n.module.split(".") if n.module else []), n.level
                tries = [parts] if a.name == "*" else [[*parts, a.name], parts]
                bound, whole, spec = a.asname or a.name, True, "." * level + (n.module or "")
            if level:
                base = pp.dirname(path)
                for _ in range(level - 1):
                    base = pp.dirname(base)
                roots = [base]
            else:
                roots = [] if project_dir is None else [project_dir, pp.join(project_dir, "src")]
            paths = []
            for root in roots:
                for t in tries:
                    rel = "/".join(t)
                    paths += [pp.join(root, rel + ".py"), pp.join(root, rel, "__init__.py")] if t else [pp.join(root, "__init__.py")]
            keys = [(i, "f:" + pp.normpath(p)) for i, p in enumerate(paths)]
            ext = [(0, normal(parts[0]))] if parts and not level else []
            if bound != "*":
                alias.setdefault(bound, [])
                alias[bound] = [len(out.imports)] if whole else []
            out.imports.append(Site(spec, n.lineno, n.end_lineno, keys, ext))

    def called(f, caller, node):
        if isinstance(f, ast.Name):
            out.calls.append(Call(caller, f.id, "function", node.lineno, node.end_lineno))
        elif isinstance(f, ast.Attribute):
            base = f.value.id if isinstance(f.value, ast.Name) else None
            if base in alias:
                out.calls.append(Call(caller, f.attr, "function", node.lineno, node.end_lineno, via=alias[base], strict=True))
            else:
                out.calls.append(Call(caller, f.attr, "method", node.lineno, node.end_lineno))

    # One stack instead of recursion; a decorator belongs to what it decorates.
    todo = [(tree, -1, False)]
    while todo:
        n, caller, skip = todo.pop()
        here = owner_of.get(id(n), caller)
        decorators = getattr(n, "decorator_list", [])
        if decorators and id(n) in owner_of:
            for d in decorators:
                called(d.func if isinstance(d, ast.Call) else d, here, d)
        if isinstance(n, ast.Call) and here >= 0 and not skip:
            called(n.func, here, n)
        for c in reversed(list(ast.iter_child_nodes(n))):
            todo.append((c, here, id(n) in owner_of and any(c is d for d in decorators) and isinstance(c, ast.Call)))
    out.calls.sort(key=lambda c: c.line)
    return out

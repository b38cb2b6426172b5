"""Languages, manifest families, and what counts as a test or a tooling configuration file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language, language to manifest family, excluded by default.
LANGUAGE = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java", "py": "python"}
FAMILY = {"typescript": "npm", "javascript": "npm", "go": "go", "rust": "rust", "java": "java", "python": "python"}
FAMILIES = sorted(set(FAMILY.values()))
EXCLUDED = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/target/**", "**/vendor/**", "**/.stryker-tmp/**", "**/.pnpm-store/**"]
# Path patterns of test files and of tooling configuration.
TEST = [
    r"\.(test|spec)\.(?:d\.)?[^./]+$",
    r"(^|/)(?:test|tests|__tests__)/.*\.(?:d\.)?[cm]?[jt]sx?$",
    r"_test\.go$",
    r"(^|/)src/test/",
    r"(?:Test|Tests)\.java$",
    r"(^|/)tests/[^/]+\.rs$",
    r"(^|/)test_[^/]+\.py$",
    r"_test\.py$",
    r"(^|/)(?:test|tests)/.*\.py$",
    r"(^|/)conftest\.py$",
]
CONFIG = [
    r"(^|/)(?:eslint|vite|vitest|jest|babel|webpack|rollup|rolldown|rspack|esbuild|tsup|postcss|tailwind|commitlint|stylelint|prettier|playwright|cypress|next|nuxt|stryker|lint-staged|husky|release|knip|biome)\.config\.[cm]?[jt]sx?$",
    r"(^|/)\.(?:eslintrc|babelrc|prettierrc|stylelintrc)\.[cm]?[jt]sx?$",
]


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def language_of(extension: Column) -> Column:
    return _looked_up(extension, LANGUAGE)


def family_of(language: Column) -> Column:
    return _looked_up(language, FAMILY)


def _any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in patterns))


def is_test(path: Column) -> Column:
    return _any(path, TEST)


def is_config(path: Column) -> Column:
    return _any(path, CONFIG)

"""Which files of a repository are ingested, and why the others are not."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import extension

MAX_BYTES = 5 * 1024 * 1024
#: Directory parts, file names, path endings and parts, and extensions that are skipped; extensions that are taken (fixed values).
SKIPPED_PARTS = [
    ".git", ".github", ".gitlab", ".hg", ".svn", "node_modules", "dist", "build", ".next", ".svelte-kit", ".turbo", ".vercel", ".parcel-cache", ".cache",
    "__pycache__", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", ".pnpm-store", ".yarn", ".husky", ".changeset", "out", "coverage", "tmp", "vendor", "storybook-static",
    "logs", "log", "obj", "bin",
]
SKIPPED_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "cargo.lock", "worker-configuration.d.ts", "composer.lock", "poetry.lock", "pipfile.lock", "coverage-final.json", "report.html", ".ds_store", "thumbs.db", "desktop.ini",
]
SKIPPED_ENDINGS = [
    ".min.js", ".min.mjs", ".min.cjs", ".min.ts", ".min.tsx", ".min.jsx", ".min.css", ".bundle.js", ".bundle.css", ".log", ".bak", ".backup", ".old", ".orig",
    "~",
]
SKIPPED_WITHIN = ["cypress/videos/", "cypress/screenshots/", "backup/", "backups/"]
SKIPPED_EXTENSIONS = [
    "svg", "xml", "csv", "tsv", "map", "png", "jpg", "jpeg", "gif", "bmp", "webp", "avif", "ico", "tif",
    "tiff", "heic", "heif", "pdf", "mp3", "wav", "flac", "ogg", "mp4", "mov", "mkv", "webm", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "pages", "numbers", "key", "psd", "ai", "sketch", "fig", "exe", "dll", "so",
    "dylib", "a", "o", "obj", "jar", "war", "ear", "apk", "ipa", "app", "dmg", "iso", "parquet", "feather",
    "h5", "hdf5", "npy", "pkl", "orc", "avro", "sav", "dta", "rds", "rdata", "sas7bdat", "mat", "bak", "sqlite",
    "sqlite3", "db", "zip", "gz", "tgz", "rar", "7z", "bz2", "xz", "tar", "woff", "woff2", "ttf", "otf",
    "eot", "wasm",
]
TEXT_EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "md", "mdx", "txt", "rst", "adoc", "css", "scss", "sass",
    "less", "html", "htm", "vue", "svelte", "astro", "pug", "py", "pyi", "pyx", "rb", "r", "go", "rs",
    "java", "kt", "kts", "scala", "swift", "php", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "cs",
    "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "make", "mk", "gradle", "groovy", "rake", "gemspec", "sql",
    "graphql", "gql", "proto", "lua", "dockerfile",
]
SPECIAL_NAMES = ["Dockerfile", "Makefile", "Rakefile", "Gemfile"]


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob with **, *, ?, [..] and {a,b}."""
    out, k, g = "", 0, glob.strip()
    while k < len(g):
        if g.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif g.startswith("**", k):
            out, k = out + ".*", k + 2
        elif g[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif g[k] == "?":
            out, k = out + "[^/]", k + 1
        elif g[k] == "[" and "]" in g[k + 1 :]:
            end = g.index("]", k + 1)
            out, k = out + "[" + g[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif g[k] == "{" and "}" in g[k:]:
            end = g.index("}", k)
            out, k = out + "(?:" + "|".join(glob_pattern(x)[2:-2] for x in g[k + 1 : end].split(",")) + ")", end + 1
        else:
            out, k = out + re.escape(g[k]), k + 1
    return rf"\A{out}\z"


def skip_reason(path: Column, size: Column, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not ingested; null if it is."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    base = F.element_at(parts, -1)
    low, ext = F.lower(p), extension(p)
    special = base.isin(SPECIAL_NAMES)
    hidden = F.exists(parts, lambda x: x.startswith(".") | F.lower(x).isin(SKIPPED_PARTS))
    ends = F.lit(False)
    for x in SKIPPED_ENDINGS:
        ends = ends | low.endswith(x)
    within = F.lit(False)
    for x in SKIPPED_WITHIN:
        within = within | low.contains(x)
    wanted = [x.strip().lower().removeprefix(".") for x in extensions or [] if x.strip()]
    listed = ext.isin(wanted) if wanted else (ext == "") | ext.isin(TEXT_EXTENSIONS) | special
    out = (
        F.when(hidden, "directory").when(F.lower(base).isin(SKIPPED_NAMES), "file_name").when(ends, "path_ending").when(within, "path_part")
        .when(ext.isin(SKIPPED_EXTENSIONS), "extension").when((ext == "") & ~special, "no_extension").when(~listed, "not_listed")
    )
    match = lambda globs: p.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    if include:
        out = out.when(~match(include), "not_included")
    if exclude:
        out = out.when(match(exclude), "excluded")
    return out.when(size > max_bytes, "file_too_large")

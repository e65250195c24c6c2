"""File kind and role from the name, language from a shebang, text from bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Names and extensions by kind, in the order in which they are tried.
IDENTITY = ("claude.md", "agents.md", "agent.md", "gemini.md", "soul.md", "memory.md", "identity.md", ".cursorrules", ".windsurfrules", ".clinerules", ".roorules", "copilot-instructions.md")
ROOT_CONFIG = {"hooks.json": "hooks_config", ".mcp.json": "mcp_config", "plugin.json": "plugin_manifest", ".app.json": "app_manifest", "plugin.lock.json": "plugin_lock"}
AGENT_CONFIG = ("settings.json", "settings.local.json", "mcp.json", "claude_desktop_config.json", "config.toml")
SECRET_NAMES = (".env", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", ".credentials.json", "secrets.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
SECRET_EXT = (".pem", ".key", ".pfx", ".p12", ".keystore")
INSTRUCTION_EXT = (".md", ".mdc", ".markdown", ".rst")
DOC_NAMES = ("readme.md", "changelog.md", "contributing.md", "license.md", "security.md", "code_of_conduct.md", "notice.md")
SCRIPT_EXT = {
    "python": (".py", ".pyw"), "shell": (".sh", ".bash", ".zsh", ".command"), "batch": (".bat", ".cmd"), "powershell": (".ps1",),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "ruby": (".rb",), "perl": (".pl",),
}
COMPILED_EXT = {"python_bytecode": (".pyc", ".pyo"), "python_extension": (".pyd",), "native_code": (".so", ".dylib", ".dll", ".exe", ".wasm", ".node", ".jar", ".war", ".class", ".o", ".a")}
ARCHIVE_EXT = (".zip", ".gz", ".tar", ".tgz", ".whl", ".bz2", ".xz", ".rar", ".7z")
ACTIVE_EXT = (".svg", ".pdf")
ASSET_EXT = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".mp4", ".webp")


def base_name(rel: str = "rel") -> Column:
    return F.lower(F.regexp_extract(F.col(rel), r"([^/]*)$", 1))


def extension(rel: str = "rel") -> Column:
    """Lower-case extension; a name that only starts with a dot has none."""
    return F.regexp_extract(base_name(rel), r"[^.].*?(\.[^.]*)$|^[^.](\.[^.]*)$", 1)


def kind(rel: str = "rel") -> Column:
    """Kind by file name and extension alone; the first rule that fits wins."""
    name = base_name(rel)
    # the last dot that does not begin the name
    ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    out = F.when(name == "skill.md", "skill_manifest").when(name.isin(*IDENTITY), "agent_identity")
    for n, k in ROOT_CONFIG.items():
        out = out.when(name == n, k)
    out = out.when(name.isin(*AGENT_CONFIG), "agent_config").when(name.isin(*SECRET_NAMES) | ext.isin(*SECRET_EXT), "secret_material")
    out = out.when(ext.isin(*INSTRUCTION_EXT), F.when(name.isin(*DOC_NAMES), "doc").otherwise("instruction"))
    for language, exts in SCRIPT_EXT.items():
        out = out.when(ext.isin(*exts), f"script_{language}")
    for k, exts in COMPILED_EXT.items():
        out = out.when(ext.isin(*exts), k)
    return (
        out.when(name.rlike(r"\.so(\.[0-9]+)+$"), "native_code")
        .when(name.isin("package.json", "pyproject.toml") | name.endswith(".txt") & name.contains("requirements"), "dep_manifest")
        .when(ext.isin(*ARCHIVE_EXT), "nested_archive")
        .when(ext.isin(*ACTIVE_EXT), "active_asset")
        .when(ext.isin(*ASSET_EXT), "asset")
        .otherwise("other")
    )


def role(kind_col: str | Column = "kind") -> Column:
    k = F.col(kind_col) if isinstance(kind_col, str) else kind_col
    return (
        F.when(k == "skill_manifest", "instruction_primary")
        .when(k == "agent_identity", "identity")
        .when(k.isin(*ROOT_CONFIG.values()), "root_config")
        .when(k == "agent_config", "config")
        .when(k == "secret_material", "secret")
        .when(k == "doc", "documentation")
        .when(k == "instruction", "instruction_secondary")
        .when(k.startswith("script_"), "script")
        .when(k.isin(*COMPILED_EXT), "compiled")
        .when(k == "dep_manifest", "dependency_manifest")
        .when(k.isin("nested_archive", "active_asset"), "opaque")
        .otherwise(k)
    )


def shebang_language(text: str = "text") -> Column:
    """Language an interpreter line names, '' if there is none; only the first 256 characters of the first line count."""
    first = F.substring(F.substring_index(F.col(text), "\n", 1), 1, 256)
    name = F.lower(F.regexp_extract(first, r"(?i)^#![ \t]*(?:[^ \t]*/env(?:[ \t]+-S)?[ \t]+|[^ \t]*/)?(python(?:[0-9]+(?:\.[0-9]+)*)?|bash|sh|zsh|dash|ksh|fish|pwsh|powershell|node|deno|bun|ruby|perl)(?:[ \t]|$)", 1))
    return (
        F.when(name.startswith("python"), "python")
        .when(name.isin("bash", "sh", "zsh", "dash", "ksh", "fish"), "shell")
        .when(name.isin("pwsh", "powershell"), "powershell")
        .when(name.isin("node", "deno", "bun"), "javascript")
        .otherwise(name)
    )


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("exception", StringType())]))
def decode_bytes(raw: pd.Series) -> pd.DataFrame:
    """UTF-8 (mark removed), else Windows-1252; NUL bytes are binary, the five undefined bytes cannot be decoded."""

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        if b is None:
            return None, None
        b = bytes(b)
        if b"\0" in b:
            return None, "binary_content"
        try:
            return b.decode("utf-8-sig"), None
        except UnicodeDecodeError:
            try:
                return b.decode("cp1252"), None
            except UnicodeDecodeError:
                return None, "undecodable_text"

    return pd.DataFrame([one(b) for b in raw], columns=["text", "exception"])


def manifest_kind(text: str = "text") -> Column:
    """Kind of a JSON configuration by its content: servers, hooks, lock file, plugin or generic; null if it is no JSON object."""
    there = lambda key: F.expr(f"array_contains(json_object_keys({text}), '{key}')")
    ok = F.expr(f"try_parse_json({text}) IS NOT NULL AND schema_of_variant(try_parse_json({text})) LIKE 'OBJECT%'")
    return F.when(ok, F.when(there("mcpServers"), "mcp_servers").when(there("hooks"), "hooks").when(there("lockfileVersion") | there("packages") & there("version") & ~there("description"), "lockfile").when(there("name") & there("version"), "plugin").otherwise("generic"))

"""Text functions: tokens, redaction, truncation, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secrets, whatever their case, and what takes their place. Fixed values.
SECRETS = [
    (r"api[_-]?key\s*[:=]\s*['\"].+?['\"]", "api_key = '***REDACTED***'"),
    (r"password\s*[:=]\s*['\"].+?['\"]", "password = '***REDACTED***'"),
    (r"secret\s*[:=]\s*['\"].+?['\"]", "secret = '***REDACTED***'"),
    (r"token\s*[:=]\s*['\"].+?['\"]", "token = '***REDACTED***'"),
    (r"credential\s*[:=]\s*['\"].+?['\"]", "credential = '***REDACTED***'"),
    (r"private[_-]?key\s*[:=]\s*['\"].+?['\"]", "private_key = '***REDACTED***'"),
    (r"access[_-]?key\s*[:=]\s*['\"].+?['\"]", "access_key = '***REDACTED***'"),
    (r"secret[_-]?key\s*[:=]\s*['\"].+?['\"]", "secret_key = '***REDACTED***'"),
    (r"connection[_-]?string\s*[:=]\s*['\"].+?['\"]", "connection_string = '***REDACTED***'"),
    (r"database[_-]?url\s*[:=]\s*['\"].+?['\"]", "database_url = '***REDACTED***'"),
    (r"-----BEGIN (?:RSA |DSA |EC )?PRIVATE KEY-----[\s\S]+?-----END", "***REDACTED PRIVATE KEY***"),
]
#: Languages of file extensions. Fixed values.
EXTENSIONS = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "html": "html"}
#: Words that stay themselves in code; other words become ID. Fixed values.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split(),
    "javascript": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield".split(),
}
_STRINGS = r""""(?:\\[\s\S]|[^"\\])*+(?:"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)"""
_REST = r"[A-Za-z_]\w*+|[0-9][0-9.]*+|==|!=|<=|>=|\+=|-=|\*=|/=|//|\*\*|->|=>|<<|>>|&&|\|\||\+\+|--|\?\?|\?\.|\S"
_COMMENTS = {
    "python": r"""#[^\n]*+|\"\"\"(?:[\s\S]*?\"\"\"|[\s\S]*?(?=[\s\S]{0,2}\z))|'''(?:[\s\S]*?'''|[\s\S]*?(?=[\s\S]{0,2}\z))""",
    "java": r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0)


def code_tokens(code: Column, language: str = "python") -> Column:
    """Tokens of code: comments go, strings become STR, numbers NUM, words that are no keywords ID."""
    python = language == "python"
    pattern = "(" + _COMMENTS["python" if python else "java"] + "|" + _STRINGS + "|" + _REST + ")"
    found = F.regexp_extract_all(code, F.lit(pattern), 1)
    comment = (lambda t: t.startswith("#") | t.startswith('"""') | t.startswith("'''")) if python else (lambda t: t.startswith("/*") | t.startswith("//"))
    kept = F.filter(found, lambda t: ~comment(t))
    words_of = F.array(*[F.lit(w) for w in KEYWORDS.get(language, [])]) if KEYWORDS.get(language) else F.array().cast("array<string>")
    return F.transform(kept, lambda t: F.when(t.startswith('"') | t.startswith("'"), F.lit("STR")).when(t.rlike("^[0-9]"), F.lit("NUM")).when(t.rlike("^[A-Za-z_]"), F.when(F.array_contains(words_of, t), t).otherwise(F.lit("ID"))).otherwise(t))


def redacted(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, f"(?i){pattern}", put)
    return text


def truncated(text: Column, lines: int, trailer: str = "... ({} more lines)") -> Column:
    """The first lines, and a trailer that counts the others."""
    parts = F.split(text, "\n")
    more = F.size(parts) - lines
    before, after = trailer.split("{}")
    return F.when(more <= 0, text).otherwise(F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n" + before), more.cast("string"), F.lit(after)))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"\.([A-Za-z0-9]+)$", 1)


def language_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    out = F.lit("unknown")
    for e, language in EXTENSIONS.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A file name pattern with * and ? as a regular expression."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def included(path: Column, excluded_dirs: list[str], rules: list[str], extensions: list[str]) -> Column:
    """File filter: no excluded directory among the path's segments, the last ignore rule that fits (`!` takes back), an allowed extension."""
    outside = ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(d) for d in excluded_dirs]))
    ignored = F.lit(False)
    for rule in rules:
        back = rule.startswith("!")
        ignored = F.when(path.rlike(glob_regex(rule.removeprefix("!"))), F.lit(not back)).otherwise(ignored)
    return outside & ~ignored & F.lower(extension(path)).isin(extensions)

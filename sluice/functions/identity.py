"""Who is calling: a struct of identity features from request headers, and behaviour from token usage.

Headers are a map with lower-case names. A header with characters other than visible ASCII and spaces counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefixes in the order they are tried, with provider and kind of key.
PROVIDERS = (
    ("sk-proj-", "OpenAI", "project-key"),
    ("sk-ant-", "Anthropic", "api-key"),
    ("sk-", "OpenAI", "legacy-key"),
    ("hf_", "HuggingFace", "hub-token"),
    ("AIza", "Google", "gemini-key"),
    ("gsk_", "Groq", "api-key"),
    ("dsk-", "DeepSeek", "api-key"),
    ("xai-", "xAI", "grok-key"),
)

# What a lower-cased user agent contains, in the order tried: framework, the name before the version, display name.
FRAMEWORKS = (
    (("langchain",), "langchain", "langchain", "LangChain Agent"),
    (("crewai",), "crewai", "crewai", "CrewAI Agent"),
    (("openai-python", "openai/python"), "openai-sdk", "openai", "OpenAI SDK Agent"),
    (("anthropic",), "anthropic-sdk", None, "Anthropic SDK Agent"),
    (("autogen",), "autogen", None, "AutoGen Agent"),
    (("llamaindex",), "llamaindex", None, "LlamaIndex Agent"),
    (("ollama",), "ollama", None, "Ollama Client"),
)
UNKNOWN_AGENT = "Unknown Agent"

# What a user agent contains, case-sensitively, and the tool it shows.
TOOLS = ((("claude-code", "ClaudeCode"), "claude-code"), (("cursor", "Cursor"), "cursor"), (("copilot",), "copilot"), (("vscode", "VSCode"), "vscode"))


def _null() -> Column:
    return F.lit(None).cast("string")


def header(headers: Column, name: str) -> Column:
    value = F.try_element_at(headers, F.lit(name))
    return F.when(value.rlike(r"\A[\x20-\x7E\t]*\z"), value)


def api_key(headers: Column) -> Column:
    """The authorization header without any leading "Bearer "; empty if absent."""
    return F.regexp_replace(F.coalesce(header(headers, "authorization"), F.lit("")), r"\A(?:Bearer )+", "")


def identity_hash(key: Column) -> Column:
    """16 hex digits that stand for the key, and for it alone."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def _first(tests: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(tests):
        out = F.when(test, value).otherwise(out)
    return out


def provider(key: Column) -> Column:
    return _first([(F.startswith(key, F.lit(p)), F.lit(name)) for p, name, _ in PROVIDERS], _null())


def key_type(key: Column) -> Column:
    return _first([(F.startswith(key, F.lit(p)), F.lit(kind)) for p, _, kind in PROVIDERS], _null())


def _has(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def framework(agent: Column) -> Column:
    return _first([(_has(F.lower(agent), words), F.lit(name)) for words, name, _, _ in FRAMEWORKS], _null())


def version_after(agent: Column, name: str) -> Column:
    """Digits and dots after the first `name` and any of "/ -"; null if there are none."""
    return F.nullif(F.regexp_extract(agent, rf"(?is)\A.*?{name}[/ -]*([0-9.]*)", 1), F.lit(""))


def sdk_version(agent: Column) -> Column:
    return _first([(_has(F.lower(agent), words), version_after(agent, at) if at else _null()) for words, _, at, _ in FRAMEWORKS], _null())


def framework_display(agent: Column) -> Column:
    return _first([(_has(F.lower(agent), words), F.lit(shown)) for words, _, _, shown in FRAMEWORKS], F.lit(UNKNOWN_AGENT))


def display_name(tool: Column, host: Column, user: Column, agent: Column) -> Column:
    return _first(
        [
            (tool.isNotNull() & host.isNotNull(), F.concat(tool, F.lit(" / "), host)),
            (tool.isNotNull() & user.isNotNull(), F.concat(tool, F.lit(" / "), user)),
            (tool.isNotNull(), F.concat(tool, F.lit(" Agent"))),
            (host.isNotNull() & user.isNotNull(), F.concat(user, F.lit("'s "), host)),
            (host.isNotNull(), host),
        ],
        framework_display(agent),
    )


def fingerprint(headers: Column) -> Column:
    """The identity struct of a request, 17 fields; only hash and api_type are never null, source_ip always is."""
    headers = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    agent, key = F.coalesce(header(headers, "user-agent"), F.lit("")), api_key(headers)
    host, user = header(headers, "x-agent-host"), header(headers, "x-agent-user")
    named = F.coalesce(header(headers, "x-agent-tool"), header(headers, "x-agent-framework"))
    shown = _first([(_has(agent, words), F.lit(tool)) for words, tool in TOOLS], _null())
    native = F.map_contains_key(headers, "x-api-key") & F.map_contains_key(headers, "anthropic-version")
    fields = {
        "hash": identity_hash(key),
        "display_name": display_name(named, host, user, agent),
        "framework": framework(agent),
        "sdk_version": sdk_version(agent),
        "source_ip": _null(),
        "api_key_prefix": F.when(F.length(key) >= 8, F.concat(F.substring(key, 1, 8), F.lit("..."))),
        "provider": provider(key),
        "key_type": key_type(key),
        "sdk_lang": header(headers, "x-stainless-lang"),
        "sdk_os": header(headers, "x-stainless-os"),
        "sdk_arch": header(headers, "x-stainless-arch"),
        "sdk_runtime": header(headers, "x-stainless-runtime"),
        "sdk_runtime_version": header(headers, "x-stainless-runtime-version"),
        "api_type": F.when(native, "anthropic-native").otherwise("openai-compatible"),
        "agent_host": host,
        "agent_user": user,
        "agent_tool": F.coalesce(named, shown),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def behavior(prompt_tokens: Column, completion_tokens: Column, method: Column) -> Column:
    """embedding, classification, rag-pipeline, code-generation or chat, from one call's token counts."""
    ratio = prompt_tokens.cast("float") / F.greatest(completion_tokens, F.lit(1)).cast("float")
    tests = [(method == "embeddings", "embedding"), (completion_tokens == 0, "classification"), (ratio > 10, "rag-pipeline"), (ratio < 0.5, "code-generation")]
    return _first([(t, F.lit(v)) for t, v in tests], F.lit("chat"))

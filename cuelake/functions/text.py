"""Time and text column functions; all but the edit distance are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import edit_distance

# Unicode white space as one class, in a syntax that Java and RE2 share (Java's \s is ASCII only).
WS = r"[\s\x0B\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TIMESTAMP = r"(\d+):(\d{2}):(\d{2}),(\d{3})"
TIMING = TIMESTAMP + WS + "*-->" + WS + "*" + TIMESTAMP
REPETITION = r"(?s)(.{2,20}?)\1{4,}"
TRAILING = "[" + WS[1:-1] + ".,!?~…、。！？]+$"
SPEAKER = "[[SPEAKER]]"
ASR_TAG = "<asr_text>"


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def _clock(sec: Column, point: str) -> Column:
    ms = F.bround(sec * 1000).cast("long")
    part = lambda div, mod: F.floor(ms / div) % mod if mod else F.floor(ms / div)
    return F.format_string(f"%02d:%02d:%02d{point}%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def srt_timestamp(sec: Column) -> Column:
    """HH:MM:SS,mmm of non-negative seconds, milliseconds rounded half to even."""
    return _clock(sec, ",")


def hms(sec: Column) -> Column:
    """HH:MM:SS.mmm, as ``srt_timestamp``."""
    return _clock(sec, ".")


def parse_srt_timestamp(text: Column, strict: bool = False) -> Column:
    """Seconds of HH:MM:SS,mmm; null (or an error, if strict) where the text is no timestamp."""
    clean = strip(text)
    whole = f"^{TIMESTAMP}$"
    g = lambda i: F.regexp_extract(clean, whole, i).cast("long")
    value = F.when(clean.rlike(whole), g(1) * 3600 + g(2) * 60 + g(3) + g(4) / 1000)
    if strict:
        return F.coalesce(value, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not an SRT timestamp: "), text)).cast("double")))
    return value


def format_eta(sec: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; negative values count as 0."""
    s = F.greatest(F.bround(sec), F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m % 60, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def cps(n_chars: Column, seconds: Column) -> Column:
    """Characters a second; a duration of 0 counts as a nanosecond."""
    return n_chars / F.greatest(seconds, F.lit(1e-9))


def _chat(model: Column | None, messages: list[Column], **settings: Column) -> Column:
    fields = ([] if model is None else [model.alias("model")]) + [F.array(*messages).alias("messages")]
    return F.to_json(F.struct(*fields, *[v.alias(k) for k, v in settings.items()]))


def _pure_base64(data: Column) -> Column:
    """Base64 without line breaks, which Spark may put in."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def chat_payload(model: Column, prompt: Column, audio: Column, temperature: float = 1.0, top_p: float = 0.95, top_k: int = 64, max_tokens: int = 4096, thinking: bool = True) -> Column:
    """JSON of a chat-completions request with a text part and the ``audio`` bytes as a base64 part; ``thinking`` false asks the template for none."""
    part = lambda kind, text, sound: F.struct(F.lit(kind).alias("type"), text.alias("text"), sound.alias("input_audio"))
    sound = F.struct(_pure_base64(audio).alias("data"), F.lit("wav").alias("format"))
    none = F.lit(None).cast("struct<data:string,format:string>")
    content = F.array(part("text", prompt, none), part("input_audio", F.lit(None).cast("string"), sound))
    user = F.struct(F.lit("user").alias("role"), content.alias("content"))
    settings = {"temperature": F.lit(temperature), "top_p": F.lit(top_p), "top_k": F.lit(top_k), "max_tokens": F.lit(max_tokens)}
    if not thinking:
        settings["chat_template_kwargs"] = F.struct(F.lit(False).alias("enable_thinking"))
    return _chat(model, [user], **settings)


def gemini_payload(prompt: Column, audio: Column, temperature: float = 1.0, top_p: float = 0.95, top_k: int = 64, max_tokens: int = 4096) -> Column:
    """JSON of a generateContent request with a text part and the ``audio`` bytes as inline data."""
    part = lambda text, data: F.struct(text.alias("text"), data.alias("inline_data"))
    data = F.struct(F.lit("audio/wav").alias("mime_type"), _pure_base64(audio).alias("data"))
    parts = F.array(part(prompt, F.lit(None).cast("struct<mime_type:string,data:string>")), part(F.lit(None).cast("string"), data))
    settings = F.struct(F.lit(temperature).alias("temperature"), F.lit(top_p).alias("topP"), F.lit(top_k).alias("topK"), F.lit(max_tokens).alias("maxOutputTokens"))
    return F.to_json(F.struct(F.array(F.struct(parts.alias("parts"))).alias("contents"), settings.alias("generationConfig")))


# Settings of a correction request, which ends where the tagged answer does.
CORRECTION_SAMPLING = {"temperature": 0.25, "top_p": 0.8, "top_k": 20, "presence_penalty": 1.0, "repetition_penalty": 1.0, "max_tokens": 512}
CORRECTION_STOP = ["</OUTPUT>"]


def text_payload(system: Column, user: Column, sampling: dict[str, float] | None = None, stop: list[str] | None = None) -> Column:
    """JSON of a chat-completions request of text alone, without thinking: translation asks with the server's own settings, correction with ``sampling`` and ``stop`` (``correction_payload``)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    settings = {k: F.lit(v) for k, v in (sampling or {}).items()}
    if stop:
        settings["stop"] = F.array(*map(F.lit, stop))
    return _chat(None, [message("system", system), message("user", user)], **settings, chat_template_kwargs=F.struct(F.lit(False).alias("enable_thinking")))


def correction_payload(system: Column, user: Column, **changed: float) -> Column:
    """``text_payload`` with the settings of a correction request, or ``changed`` ones; its answers lack the closing tag (``tagged_output(allow_unclosed=True)``)."""
    return text_payload(system, user, {**CORRECTION_SAMPLING, **changed}, CORRECTION_STOP)


def response_text(raw: Column, provider: Column) -> Column:
    """The text of a provider's JSON response (``gemini`` or chat completions); null if it holds none."""
    gemini = F.get_json_object(raw, "$.candidates[0].content.parts[0].text")
    return F.when(provider == "gemini", gemini).otherwise(F.get_json_object(raw, "$.choices[0].message.content"))


def asr_language(content: Column) -> Column:
    """Language of ``language X<asr_text>text``; ``?`` without the tag."""
    head = F.substring_index(content, ASR_TAG, 1)
    return F.when(content.contains(ASR_TAG), strip(F.replace(head, F.lit("language"), F.lit("")))).otherwise("?")


def asr_text(content: Column) -> Column:
    """Text after the first tag, or the whole content without one."""
    at = F.instr(content, ASR_TAG)
    return strip(F.when(at > 0, content.substr(at + len(ASR_TAG), F.length(content))).otherwise(content))


def provider_answer(provider: Column, content: Column, configured: Column) -> tuple[Column, Column]:
    """(language, text) of a response's content: ``gemini`` names no language, so the configured one holds and all is text; others are parsed."""
    gemini = provider == "gemini"
    return F.when(gemini, configured).otherwise(asr_language(content)), F.when(gemini, strip(content)).otherwise(asr_text(content))


def repetition(text: Column) -> Column:
    """The shortest unit of 2 to 20 characters that stands five times in a row, leftmost first; null if there is none."""
    return F.nullif(F.regexp_extract(text, REPETITION, 1), F.lit(""))


def dedup_form(text: Column) -> Column:
    """Comparison form of a transcript: white space collapsed, trailing punctuation and case dropped."""
    return F.replace(F.lower(F.regexp_replace(collapse(text), TRAILING, "")), F.lit("ß"), F.lit("ss"))


def cer_form(text: Column) -> Column:
    """Without white space and Unicode punctuation."""
    return F.regexp_replace(text, f"[{WS[1:-1]}\\p{{P}}]", "")


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of comparison forms; against an empty reference 0 for an empty hypothesis, else 1."""
    n = F.length(ref)
    return F.when(n == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(ref, hyp) / n)


def plain_prompt(language: Column) -> Column:
    return F.when(language == "auto", "Transcribe this audio.").otherwise(F.concat(F.lit("language: "), language))


def vocabulary_block(terms: Column) -> Column:
    """A list of terms as a prompt block; blank terms are dropped, no block without terms."""
    lines = F.transform(F.filter(terms, lambda t: strip(t) != ""), lambda t: F.concat(F.lit("- "), t))
    block = F.concat(F.lit("Vocabulary (proper nouns/terms that may appear):\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    return F.when(F.size(lines) > 0, block).otherwise("")


def template_prompt(template: Column, context: Column, language: Column, terms: Column) -> Column:
    """``template`` with {{language_hint}}, {{vocabulary}} and {{context}} substituted in this order."""
    hint = F.when(language.isin("", "auto") | language.isNull(), "").otherwise(F.concat(F.lit("language: "), language, F.lit("\n\n")))
    out = F.replace(template, F.lit("{{language_hint}}"), hint)
    out = F.replace(out, F.lit("{{vocabulary}}"), vocabulary_block(terms))
    return F.replace(out, F.lit("{{context}}"), context)


def translation_prompt(template: Column, target_language: Column, terms: Column) -> Column:
    out = F.replace(template, F.lit("{{target_language}}"), target_language)
    return F.replace(out, F.lit("{{vocabulary}}"), vocabulary_block(terms))


def tagged_output(raw: Column, fallback: Column, allow_unclosed: bool = False) -> Column:
    """Text between <OUTPUT> tags; the fallback where tags or text are missing."""
    end = r"(?:</OUTPUT>|\z)" if allow_unclosed else "</OUTPUT>"
    return F.coalesce(F.nullif(strip(F.regexp_extract(raw, f"(?s)<OUTPUT>(.*?){end}", 1)), F.lit("")), fallback)


def job_key(path: Column, mtime: Column, size: Column, short: bool = False) -> Column:
    """sha1 of ``path|mtime|size``; the 8-character form is for display only."""
    key = F.sha1(F.concat_ws("|", path.cast("string"), mtime.cast("string"), size.cast("string")))
    return F.substring(key, 1, 8) if short else key

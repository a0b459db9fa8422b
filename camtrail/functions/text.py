"""Text expressions over question logs, labels, aliases and file names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from camtrail.functions import vocabulary as V

WINDOW_TYPE = "struct<t_start:timestamp_ntz,t_end:timestamp_ntz,span:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once; keeps nested expressions linear in size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word_map(words: dict[str, list[str]]) -> Column:
    return F.create_map(*[c for k, v in words.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))])


def _day(now: Column) -> Column:
    return F.to_date(now).cast("timestamp_ntz")


def _clock(now: Column, hour: Column, minute: Column) -> Column:
    """The day of ``now`` at hour:minute; null when that is no time of day."""
    ok = (hour < 24) & (minute < 60)
    return F.when(ok, _day(now) + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0)))


def _ago(now: Column, hours: Column, minutes: Column) -> Column:
    return now - F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))


def time_window(text: Column, now: Column) -> Column:
    """Time window asked for by a question: STRUCT<t_start, t_end, span>, null without a time phrase."""
    return _let(F.lower(text), lambda low: _window(low, text, now))


def _window(low: Column, text: Column, now: Column) -> Column:

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(low, pattern, group).try_cast("int")

    def rule(pattern: str, start: Column, end: Column, source: Column = low) -> Column:
        span = F.regexp_extract(source, pattern, 0)
        fields = F.struct(start.alias("t_start"), end.alias("t_end"), span.alias("span"))
        return F.when(source.rlike(pattern), fields.cast(WINDOW_TYPE))

    zero = F.lit(0)
    day = _day(now)

    def at(hours: int, minutes: int = 0, seconds: float = 0) -> Column:
        return day + F.make_dt_interval(zero, F.lit(hours), F.lit(minutes), F.lit(seconds))

    yesterday = day - F.make_dt_interval(F.lit(1))
    p12 = V.BETWEEN_12H
    half2 = F.regexp_extract(low, p12, 6)
    half1 = F.coalesce(F.nullif(F.regexp_extract(low, p12, 3), F.lit("")), half2)

    def hour12(hour: Column, half: Column) -> Column:
        return (
            F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), zero).otherwise(hour)
        )

    start12 = _clock(now, hour12(number(p12, 1), half1), F.coalesce(number(p12, 2), zero))
    end12 = _clock(now, hour12(number(p12, 4), half2), F.coalesce(number(p12, 5), zero))
    p24 = V.BETWEEN_24H
    instant = F.regexp_replace(F.regexp_extract(text, V.ISO_INSTANT, 1), r"\s", "T").try_cast("timestamp_ntz")
    five = F.make_dt_interval(zero, zero, F.lit(5))
    return F.coalesce(
        rule(V.LAST_MINUTES, _ago(now, zero, number(V.LAST_MINUTES, 1)), now),
        rule(V.LAST_HOURS, _ago(now, number(V.LAST_HOURS, 1), zero), now),
        rule(V.LAST_HOUR, _ago(now, F.lit(1), zero), now),
        rule(V.TODAY, day, now),
        rule(V.YESTERDAY, yesterday, day - F.expr("INTERVAL '0.000001' SECOND")),
        rule(V.MORNING, at(6), at(12)),
        rule(V.AFTERNOON, at(12), at(18)),
        rule(V.EVENING, at(18), at(23, 59, 59)),
        rule(p12, start12, end12),
        rule(p24, _clock(now, number(p24, 1), number(p24, 2)), _clock(now, number(p24, 3), number(p24, 4))),
        rule(V.ISO_INSTANT, instant - five, instant + five, text),
    )


def without_span(text: Column, span: Column) -> Column:
    """Text with every occurrence of the time phrase blanked, whatever its case."""
    pattern = F.concat(F.lit(r"(?i)\Q"), span, F.lit(r"\E"))
    return F.when(F.coalesce(span, F.lit("")) == "", text).otherwise(F.regexp_replace(text, pattern, F.lit(" ")))


def place_and_rest(text: Column) -> Column:
    """First place named in the text and the text without it: STRUCT<place, rest>."""
    return _let(text, _place)


def _place(text: Column) -> Column:
    out = F.struct(F.lit(None).cast("string").alias("place"), text.alias("rest"))
    for pattern in reversed(V.PLACE_PATTERNS):
        whole = r"(?is)^(.*?)" + pattern + r"(.*)$"
        found = F.struct(
            F.trim(F.regexp_extract(text, whole, 2)).alias("place"),
            F.concat(F.regexp_extract(text, whole, 1), F.lit(" "), F.regexp_extract(text, whole, 3)).alias("rest"),
        )
        out = F.when(text.rlike(whole), found).otherwise(out)
    return out


def object_prompt(rest: Column) -> Column:
    """What remains of a question once time and place are gone, with an article."""
    words = rest
    for pattern in V.FILLER_PATTERNS:
        words = F.regexp_replace(words, "(?i)" + pattern, " ")
    words = F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}_\s\-]", ""))
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    words = F.coalesce(F.nullif(words, F.lit("")), F.when(rest.isNotNull(), F.lit("person or vehicle")))
    has_article = r"^(?i)(?:a|an|the)(?: |$)"
    return _let(words, lambda w: F.when(w.rlike(has_article), w).otherwise(F.concat(F.lit("a "), w)))


def bare_prompt(prompt: Column) -> Column:
    return F.regexp_replace(prompt, "^(?:a|an) ", "")


def photo_prompt(prompt: Column) -> Column:
    return F.concat(F.lit("a photo of "), prompt)


def target_labels(text: Column) -> Column:
    """Sorted labels meant by the words of a question; null when no word names one."""
    lookup = _word_map(V.LABEL_WORDS)
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z]+\b"), 0))

    def meaning(word: Column) -> Column:
        s = F.when(word.endswith("s"), F.try_element_at(lookup, F.regexp_replace(word, "s$", "")))
        es = F.when(word.endswith("es"), F.try_element_at(lookup, F.regexp_replace(word, "es$", "")))
        return F.coalesce(F.try_element_at(lookup, word), s, es, F.array().cast("array<string>"))

    labels = F.array_sort(F.array_distinct(F.flatten(F.transform(words, meaning))))
    return F.when(F.size(labels) > 0, labels)


def alias_name(name: Column) -> Column:
    """Alias key: lower case, no leading "the", no punctuation, single spaces."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(name)), "^the ", ""))
    low = F.regexp_replace(low, r"[^\p{L}\p{N}_\s\-]", "")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def camera_key(camera: Column) -> Column:
    """Camera name for comparison: lower case, a leading cam_ does not matter."""
    return F.regexp_replace(F.lower(camera), "^cam_", "")


def object_group(label: Column) -> Column:
    low = F.trim(F.regexp_replace(F.trim(F.lower(label)), "^(?:a|an) ", ""))
    return (
        F.when(low.isin(V.PERSON_LABELS), F.lit("person"))
        .when(low.isin(V.VEHICLE_LABELS), F.lit("vehicle"))
        .otherwise(F.lit("object"))
    )


def detector_label(raw: Column, classes: Sequence[str]) -> Column:
    """Canonical label of a free-text detector label: exact class, keyword rule, contained class, else as is."""
    s = F.trim(F.lower(raw))
    for article in ("a", "an", "the"):
        s = F.trim(F.regexp_replace(s, f"^{article} ", ""))
    return _let(s, lambda s: _canonical(s, classes))


def _canonical(s: Column, classes: Sequence[str]) -> Column:
    exact = F.coalesce(*[F.when(s == c.lower(), F.lit(c)) for c in classes], F.lit(None).cast("string"))
    keyword = F.when(s.contains("juice") & s.contains("bottle"), F.lit("juice bottle")).when(
        s.contains("juice"), F.lit("juice box")
    )
    for words, label in V.DETECTOR_KEYWORDS:
        test = F.lit(False)
        for word in words:
            test = test | s.contains(word)
        keyword = keyword.when(test, F.lit(label))
    inside = F.coalesce(*[F.when(s.contains(c.lower()), F.lit(c)) for c in classes], F.lit(None).cast("string"))
    return F.coalesce(exact, keyword, inside, s)


def colour_asked(text: Column, detected: Column) -> Column:
    """True / false when the question names colours and ``detected`` is among them or not; null without one."""
    low = F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    asked = []
    for colour, words in V.COLOUR_WORDS.items():
        test = F.lit(False)
        for word in words:
            test = test | padded.contains(f" {word} ") | low.startswith(f"{word} ")
        asked.append(F.when(test, F.lit(colour)))
    colours = F.array_compact(F.array(*asked))
    return F.when(F.size(colours) > 0, F.array_contains(colours, detected))


def query_colours(text: Column) -> Column:
    """Colour words among the whitespace-separated words of a question."""
    return F.array_intersect(
        F.split(F.lower(text), r"\s+"), F.array(*[F.lit(c) for c in V.QUERY_COLOURS])
    )


def row_colours(colours_json: Column) -> Column:
    """Flat list of the known colours of a row, from {part: [{color, fraction}]}."""
    parsed = F.from_json(colours_json, "map<string,array<struct<color:string,fraction:double>>>")
    names = F.transform(F.flatten(F.map_values(parsed)), lambda i: F.lower(i["color"]))
    known = F.filter(names, lambda n: n.isNotNull() & ~n.isin("", "unknown"))
    return F.coalesce(known, F.array().cast("array<string>"))


def colour_boost(asked: Column, known: Column, match: float = 0.03, mismatch: float = 0.02) -> Column:
    return (
        F.when(F.size(asked) == 0, F.lit(0.0))
        .when(F.arrays_overlap(asked, known), F.lit(match))
        .when(F.size(known) > 0, F.lit(-mismatch))
        .otherwise(F.lit(0.0))
    )


def label_boost(keyword: Column, label: Column, boost: float = 0.025) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, keyword) | F.contains(keyword, low), F.lit(boost)).otherwise(F.lit(0.0))


def clean_spoken(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def rewrite_spoken_cameras(text: Column) -> Column:
    """Replace spoken camera mentions by camera names and squeeze doubled prepositions."""
    for pattern, name in V.SPOKEN_REWRITES:
        text = F.regexp_replace(text, "(?i)" + pattern, name)
    text = F.regexp_replace(text, "(?i)" + V.DOUBLED_PREPOSITION, "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def spoken_camera(camera: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in V.CAMERA_SPOKEN_NAMES.items() for x in kv])
    key = F.trim(F.lower(camera))
    plain = F.replace(key, F.lit("_"), F.lit(" "))
    return F.when(F.coalesce(camera, F.lit("")) == "", F.lit("the camera")).otherwise(
        F.coalesce(F.try_element_at(names, key), plain)
    )


def spoken_time(ts: Column, offset_s: Column) -> Column:
    """"at 3:22 AM", "at 6 PM", or "at 12.5 seconds" without a time."""
    clock = F.when(F.minute(ts) == 0, F.date_format(ts, "h a")).otherwise(F.date_format(ts, "h:mm a"))
    seconds = F.concat(F.format_string("%.1f", F.round(offset_s, 1)), F.lit(" seconds"))
    return F.concat(F.lit("at "), F.coalesce(clock, seconds))


def answer(status, referent, options, n_results, prompt, label, colour, camera, ts, offset_s) -> Column:
    """Spoken sentence for one question from its status, result count and top result."""

    def article(word: Column) -> Column:
        vowel = F.substring(word, 1, 1).isin("a", "e", "i", "o", "u")
        return F.when(vowel, F.lit("an ")).otherwise(F.lit("a "))

    n_options = F.coalesce(F.size(options), F.lit(0))
    one = spoken_camera(F.try_element_at(options, F.lit(1)))
    two = spoken_camera(F.try_element_at(options, F.lit(2)))
    clarify = (
        F.when(n_options <= 0, F.concat(F.lit("Which camera covers "), referent, F.lit("?")))
        .when(n_options == 1, F.concat(F.lit("Did you mean "), one, F.lit("?")))
        .otherwise(F.concat(F.lit("Did you mean "), one, F.lit(" or "), two, F.lit("?")))
    )
    plain = F.coalesce(colour, F.lit("unknown")).isin("unknown", "none", "")
    noun = F.when(plain, F.concat(article(label), label)).otherwise(
        F.concat(article(colour), colour, F.lit(" "), label)
    )
    when_said = F.coalesce(F.concat(F.lit(" "), spoken_time(ts, offset_s)), F.lit(""))
    place = F.concat(noun, F.lit(" on "), spoken_camera(camera), when_said, F.lit("."))
    found = (
        F.when(n_results == 0, F.concat(F.lit("No objects found matching "), prompt, F.lit(".")))
        .when(n_results == 1, F.concat(F.lit("Found "), place))
        .otherwise(
            F.concat(F.lit("Found "), n_results.cast("string"), F.lit(" matches, most recent was "), place)
        )
    )
    return (
        F.when(status == "clarify", clarify).when(status == "success", found).otherwise(F.lit("No results found."))
    )


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_time(path: Column) -> Column:
    """Start time and camera in a file name: STRUCT<start_time, camera>, null without a valid time."""
    stem = file_stem(path)
    options = []
    for pattern, has_camera in V.FILE_TIME_PATTERNS:
        base = 1 if has_camera else 0
        parts = [F.regexp_extract(stem, pattern, base + i) for i in range(1, 7)]
        stamp = F.format_string("%s-%s-%s %s:%s:%s", *parts)
        start = F.when(stem.rlike(pattern), stamp).try_cast("timestamp_ntz")
        camera = F.btrim(F.regexp_extract(stem, pattern, 1), F.lit("_ -")) if has_camera else F.lit("")
        options.append(
            F.when(
                start.isNotNull(),
                F.struct(start.alias("start_time"), F.nullif(camera, F.lit("")).alias("camera")),
            )
        )
    return F.coalesce(*options)


def track_key(prefix: Column, kind: str, number: Column) -> Column:
    return F.concat(prefix, F.lit(f"_{kind}_"), number.cast("string"))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words. Words become single code points, so the built-in levenshtein counts words."""

    def words(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.,]", ""), r"\s+", " "))
        return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))

    def edits(pair: Column) -> Column:
        ref, hyp = pair["ref"], pair["hyp"]
        known = F.array_union(ref, hyp)
        distance = F.levenshtein(spell(ref, known), spell(hyp, known))
        return F.struct(distance.alias("edits"), F.size(ref).alias("n_ref"), F.size(hyp).alias("n_hyp"))

    def spell(tokens: Column, known: Column) -> Column:
        def code(token: Column) -> Column:
            point = F.array_position(known, token) + F.lit(0x10000)
            return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

        return F.array_join(F.transform(tokens, code), "")

    return _let(F.struct(words(reference).alias("ref"), words(hypothesis).alias("hyp")), edits)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    def rate(e: Column) -> Column:
        empty = F.when(e["n_hyp"] == 0, F.lit(0.0)).otherwise(F.lit(1.0))
        return F.when(e["n_ref"] == 0, empty).otherwise(F.try_divide(e["edits"].cast("double"), e["n_ref"]))

    return _let(word_edits(reference, hypothesis), rate)


def judgement(response: Column) -> Column:
    """Parse "YES/NO | confidence | reason": STRUCT<is_match, conf, reason>."""
    text = F.trim(response)
    parts = F.split(text, r"\|")
    is_match = F.contains(F.lower(parts[0]), F.lit("yes"))
    given = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    missing = F.size(parts) < 2
    default = F.when(is_match, F.lit(0.9)).otherwise(F.lit(0.1))
    # An unreadable confidence is a failed judgement: no match, confidence 0.
    failed = ~missing & given.isNull()
    return F.struct(
        F.when(failed, F.lit(False)).otherwise(is_match).alias("is_match"),
        F.when(failed, F.lit(0.0)).when(missing, default).otherwise(given).alias("conf"),
        F.coalesce(F.trim(F.try_element_at(parts, F.lit(3))), text).alias("reason"),
    )

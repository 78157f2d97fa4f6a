"""Answer memory, questions, mail evidence, resumes against profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.contacts import phone_norm, split_name
from vacantia.functions.text import contains_any, let, memory_norm, question_category, squeeze

COMPANY, CATEGORY = "company:", "category:"
GRAM = 12  # both sides need this many characters before a contained question counts
# Phrases that confirm an application was received.
CONFIRMATION_TERMS = (
    "application received", "thank you for applying", "thanks for applying", "application submitted",
    "we received your application", "מועמדותך התקבלה", "קיבלנו את מועמדותך", "קורות החיים התקבלו",
)
SUCCESS_TERMS = (
    "application submitted", "thank you for applying", "thanks for applying", "application received", "successfully submitted",
    "your application has been submitted", "your application was already submitted", "thanks for your application",
    "מועמדותך התקבלה", "הבקשה נשלחה", "תודה שהגשת",
)


def company_key(company: Column) -> Column:
    return F.substring(F.sha2(memory_norm(company), 256), 1, 24)


def memories(answers: DataFrame) -> DataFrame:
    """Stored answers with their scope: ``company_hash`` (null when global), category and bare pattern."""
    pattern = F.col("pattern")
    is_company = pattern.startswith(COMPANY)
    rest = F.regexp_replace(pattern, f"^{COMPANY}[^:]*:", "")
    return answers.withColumns({
        "company_hash": F.when(is_company, F.split_part(pattern, F.lit(":"), F.lit(2))),
        "scope": F.when(is_company, "company").otherwise("global"), "bare": F.when(is_company, rest).otherwise(pattern),
        "category": F.when(pattern.startswith(CATEGORY), F.regexp_replace(pattern, f"^{CATEGORY}", "")).otherwise("")})


def answer_memory_scope(answers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Usable answers of each claimed job: those of its company first, then the global ones.

    ``jobs`` holds the claimed job of a user (one per user), so the join is as large as the answers.
    """
    rows = memories(answers.filter("auto_use")).join(jobs.select("user_id", "job_id", company_key(F.col("company")).alias("job_hash")), "user_id")
    rows = rows.filter(F.col("company_hash").isNull() | ((F.col("company_hash") == F.col("job_hash")) & (F.col("bare") != "")))
    return rows.select("user_id", "job_id", "answer_id", F.col("bare").alias("pattern"), "answer", "category", "scope",
                       F.when(F.col("scope") == "company", 0).otherwise(1).alias("priority"))


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct substrings of ``size`` characters (cut from the character array, so the cost is linear in the text)."""
    def cut(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - size + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, size), "")))

    return F.when(F.length(text) >= size, let(F.split(text, ""), cut)).otherwise(F.array().cast("array<string>"))


def _containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (user_id, text, ...) joined with those of ``parts`` (user_id, part, ...) of the same user that the text contains.

    A text has about as many pieces as characters, so what is shuffled per piece is two numbers: a hash of user and piece, and one of
    user and text.  Texts meet the candidates afterwards, once per pair, and are tested exactly; equal hashes of others drop out there.
    """
    user, piece, place = F.col("user_id"), "piece", "place"
    pieces = texts.select(F.xxhash64(user, "text").alias(place), F.explode(F.transform(grams(F.col("text")), lambda g: F.xxhash64(user, g))).alias(piece))
    heads = parts.select(F.xxhash64(user, F.substring("part", 1, GRAM)).alias(piece), F.xxhash64(user, "part").alias("inner_place"))
    pairs = pieces.join(heads, piece).select(place, "inner_place").distinct()
    rows = texts.withColumn(place, F.xxhash64(user, "text")).join(pairs, place)
    found = rows.join(parts.withColumn("inner_place", F.xxhash64(user, "part")), ["user_id", "inner_place"])
    return found.filter(F.col("text").contains(F.col("part"))).drop(place, "inner_place")


def answer_resolve(questions: DataFrame, answers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Answer of each question: the first fitting memory (company scope, then oldest), else a profile field.

    A memory fits by category, by the same normal text, or (global, both at least 12 characters) when one
    text contains the other.  Containment is an equi-join on 12-character pieces followed by the exact test:
    a text inside another shares its first 12 characters with some piece of it.  Equal questions of a user
    are resolved once.
    """
    asked = questions.select("user_id", "question_id", company_key(F.col("company")).alias("job_hash"), memory_norm(F.col("question")).alias("key"), question_category(F.col("question")).alias("asked_category"))
    distinct = asked.select("user_id", "job_hash", "key", "asked_category").distinct()
    stored = memories(answers).withColumn("norm", memory_norm(F.col("bare")))
    first = F.struct(F.when(F.col("scope") == "company", 0).otherwise(1).alias("o"), F.col("answer_id").alias("id"), F.col("answer").alias("a"))
    # Equal patterns of a user: only the first one can ever win.
    best = lambda rows, keys: rows.groupBy(*keys).agg(F.min(first).alias("m"))
    on_question = ["user_id", "job_hash", "key"]
    company = best(stored.filter("scope = 'company' AND norm <> ''"), ["user_id", "company_hash", "norm"])
    exact_company = distinct.join(company.select("user_id", F.col("company_hash").alias("job_hash"), F.col("norm").alias("key"), "m"), on_question)
    general = stored.filter("scope = 'global'")
    by_category = distinct.join(best(general.filter("category <> ''"), ["user_id", "category"]).select("user_id", F.col("category").alias("asked_category"), "m"), ["user_id", "asked_category"])
    patterns = best(general.filter("norm <> ''"), ["user_id", "norm"])
    exact = distinct.join(patterns.select("user_id", F.col("norm").alias("key"), "m"), ["user_id", "key"])
    keys = distinct.select("user_id", "key").distinct()
    long_keys, long_patterns = keys.filter(F.length("key") >= GRAM), patterns.filter(F.length("norm") >= GRAM)
    inside = _containing(long_keys.withColumnRenamed("key", "text"), long_patterns.select("user_id", "norm", "m").withColumnRenamed("norm", "part"))
    around = _containing(long_patterns.select("user_id", F.col("norm").alias("text"), "m"), long_keys.withColumnRenamed("key", "part"))
    inside, around = inside.withColumnRenamed("text", "key"), around.withColumnRenamed("part", "key")
    contained = distinct.join(inside.select("user_id", "key", "m").union(around.select("user_id", "key", "m")).groupBy("user_id", "key").agg(F.min("m").alias("m")), ["user_id", "key"])
    found = None
    for rows in (exact_company, by_category, exact, contained):
        rows = rows.select(*on_question, "m")
        found = rows if found is None else found.union(rows)
    found = found.groupBy(*on_question).agg(F.min("m").alias("m"))
    people = profiles.groupBy("user_id").agg(F.min_by(F.struct("full_name", "email", "phone", "location", "linkedin_url", "years_experience"), "career_track").alias("p"))
    rows = asked.join(found, on_question, "left").join(people, "user_id", "left")
    mapped = profile_value(F.col("key"), F.col("p"))
    return rows.select("user_id", "question_id", F.coalesce("m.a", mapped).alias("answer"),
                       F.when(F.col("m").isNotNull(), F.when(F.col("m.o") == 0, "company_memory").otherwise("memory")).when(mapped.isNotNull(), "profile").otherwise("none").alias("source"))


# Label words of profile fields, in order.
FIELD_LABELS = (
    ("first_name", ("first name", "given name", "שם פרטי")), ("last_name", ("last name", "family name", "surname", "שם משפחה")),
    ("full_name", ("full name", "name", "שם מלא")), ("email", ("email", "e mail", "דוא ל", "מייל")), ("phone", ("phone", "mobile", "telephone", "טלפון", "נייד")),
    ("location", ("location", "city", "current location", "מיקום", "עיר")), ("linkedin_url", ("linkedin", "linked in")),
    ("years_experience", ("years of experience", "years experience", "שנות ניסיון")),
)


def profile_value(key: Column, profile: Column) -> Column:
    """Value of the first profile field whose label occurs in the question and that is not blank."""
    names = split_name(profile["full_name"])
    value = {"first_name": names["first_name"], "last_name": names["last_name"], **{f: profile[f].cast("string") for f in ("full_name", "email", "phone", "location", "linkedin_url", "years_experience")}}
    return F.coalesce(*[F.when(contains_any(key, words) & (F.trim(value[f]) != ""), value[f]) for f, words in FIELD_LABELS])


def _terms(text: Column, size: int) -> Column:
    """Distinct words of at least ``size`` characters; '' stands for "no term needed"."""
    words = F.array_distinct(F.filter(F.split(F.lower(squeeze(text)), " "), lambda w: F.length(w) >= size))
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)


def _occurrences(texts: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """(user_id, seq, term) for every distinct term of the user that occurs in a text.

    A term has no blanks, so it lies inside one word: the distinct words of a text are cut into pieces, joined
    with the beginnings of the terms, and tested exactly.
    """
    words = texts.select("user_id", "seq", F.explode(F.array_distinct(F.split("low", r"[\s\p{Z}]+"))).alias("word"))
    distinct = words.select("user_id", "word").distinct()
    cut = distinct.select("user_id", "word", F.explode(grams(F.col("word"), size)).alias("g"))
    named = terms.filter("term <> ''").select("user_id", "term", F.substring("term", 1, size).alias("g"))
    inside = cut.join(named, ["user_id", "g"]).filter(F.col("word").contains(F.col("term"))).select("user_id", "word", "term").distinct()
    found = words.join(inside, ["user_id", "word"]).select("user_id", "seq", "term")
    free = texts.join(terms.filter("term = ''").select("user_id"), "user_id").select("user_id", "seq", F.lit("").alias("term"))
    return found.union(free).distinct()


def email_evidence(pending: DataFrame, messages: DataFrame) -> DataFrame:
    """First message that confirms a pending application: a confirmation phrase, a company word and a title word.

    Words are substrings in the rule, so the join runs on word beginnings (3 characters for companies, 4 for
    titles) against the pieces of the confirming messages; (company word, title word) pairs are then reduced
    to their first message before they meet the applications.
    """
    low = messages.select("user_id", "seq", F.lower("text").alias("low")).filter(contains_any(F.col("low"), CONFIRMATION_TERMS))
    apps = pending.select("user_id", "application_id", F.explode(_terms(F.col("company"), 3)).alias("company_term"), "title").select(
        "user_id", "application_id", "company_term", F.explode(_terms(F.col("title"), 4)).alias("title_term"))
    wanted = lambda c: apps.select("user_id", F.col(c).alias("term")).distinct()
    companies = _occurrences(low, wanted("company_term"), 3).withColumnRenamed("term", "company_term")
    titles = _occurrences(low, wanted("title_term"), 4).withColumnRenamed("term", "title_term")
    first = companies.join(titles, ["user_id", "seq"]).groupBy("user_id", "company_term", "title_term").agg(F.min("seq").alias("seq"))
    return apps.join(first, ["user_id", "company_term", "title_term"]).groupBy("application_id").agg(F.min("seq").alias("message_seq"))


def resume_suggestions(resumes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per resume: skills the profile lacks, contact fields that differ, and blank fields it can fill."""
    keys = ["user_id", "career_track"]
    people = profiles.select(*keys, F.transform("skills", lambda s: F.trim(F.lower(s))).alias("owned"), F.col("email").alias("p_email"), F.col("phone").alias("p_phone"))
    rows = resumes.join(people, keys)
    skills = rows.select("resume_id", F.explode(F.array_except(F.transform("skills", lambda s: F.trim(F.lower(s))), "owned")).alias("value")).select("resume_id", F.lit("skill").alias("kind"), F.lit("skills").alias("field"), "value")
    plain = lambda c: F.rtrim(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(".,"))
    field = lambda name, found, current, same: F.struct(F.lit(name).alias("field"), found.alias("value"), F.coalesce(current, F.lit("")).alias("current"), same.alias("same"))
    fields = F.array(field("email", F.col("email"), F.col("p_email"), plain(F.col("email")) == plain(F.col("p_email"))),
                     field("phone", F.col("phone"), F.col("p_phone"), (phone_norm(F.col("phone")) != "") & (phone_norm(F.col("phone")) == phone_norm(F.col("p_phone")))))
    stacked = rows.select("resume_id", F.explode(fields).alias("f")).select("resume_id", "f.*").filter("value <> '' AND NOT same")
    return skills.union(stacked.select("resume_id", F.when(F.trim("current") == "", "fill").otherwise("differs"), "field", "value"))


def resume_refresh(resumes: DataFrame, extracted: Column) -> DataFrame:
    """Skills of each resume after a lexicon or profile change: kept ones first, new ones after, spelling kept."""
    from vacantia.operators.profiles import ordered_union

    return resumes.withColumn("refreshed", ordered_union(F.col("skills"), F.col("manual_skills"), extracted))


def page_evidence(text: Column, before: int = 120, after: int = 240, size: int = 500) -> Column:
    """Snippet around the first success term (term order), or ''."""
    def snippet(t: Column) -> Column:
        low = F.lower(t)
        found = []
        for term in SUCCESS_TERMS:
            at = F.instr(low, term)
            start = F.greatest(F.lit(1), at - before)
            length = at + len(term) + after - start
            found.append(F.when(at > 0, F.substring(squeeze(t.substr(start, length)), 1, size)))
        return F.coalesce(*found, F.lit(""))

    return let(text, snippet)

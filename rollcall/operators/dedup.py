"""Duplicates between an upload and the people already known, and person identifiers.

Both sides carry id, dataset_id, name, email, organization and linkedin_url; the known
side also carries ``pos``, its order inside a dataset. Name matches are reported per new
row and confidence level, with how many known rows there are and the first of them, so a
common name costs rows in proportion to the input and never the product of both sides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.emails import email_key
from rollcall.functions.names import name_key, org_key
from rollcall.functions.text import first_filled, text, trim_all
from rollcall.functions.urls import dedup_url_key, loose_url_key
from rollcall.operators.grams import contained
from rollcall.operators.keyed import last_per_key, top_per_key
from rollcall.session import cut_lineage

SURE, LIKELY, UNCLEAR, UNLIKELY = 1.0, 0.9, 0.6, 0.5
# When pairs are made: known rows of a name that a new row meets at a time, new rows that meet
# them together, pairs for a task, and how many tasks at most.
PART, SLICE, TASK, TASKS = 8192, 2048, 1 << 22, 4096


def with_match_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "email_key": email_key(F.col("email")), "url_key": dedup_url_key(F.col("linkedin_url")),
        "name_key": name_key(F.col("name")), "org_key": org_key(F.col("organization")),
    })


_KEYS = ["email_key", "url_key", "name_key", "org_key"]


def _keyed(df: DataFrame, *extra: str) -> DataFrame:
    """Ids and match keys alone, computed once and read back by every join below."""
    return cut_lineage(with_match_keys(df).select("id", *extra, *_KEYS))


def _index(known: DataFrame, key: str) -> DataFrame:
    """The last known row of every key, later datasets winning."""
    return last_per_key(
        known.where(F.col(key) != ""), [key], ["dataset_id", "pos", "id"], ["id", "dataset_id", "name_key", "org_key"]
    )


def _exact(new: DataFrame, known: DataFrame, key: str, kind: str) -> DataFrame:
    index = _index(known, key).select(
        key, F.col("id").alias("existing_id"), F.col("dataset_id").alias("existing_dataset_id")
    )
    return new.where(F.col(key) != "").join(index, key).select(
        F.col("id").alias("new_id"), "existing_id", "existing_dataset_id",
        F.lit(kind).alias("match_type"), F.lit(SURE).alias("confidence"),
    )


def match_by_email(new: DataFrame, known: DataFrame) -> DataFrame:
    return _exact(with_match_keys(new), with_match_keys(known), "email_key", "email")


def match_by_url(new: DataFrame, known: DataFrame) -> DataFrame:
    return _exact(with_match_keys(new), with_match_keys(known), "url_key", "linkedin")


def _three_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The three smallest ids of every key: enough to survive the two exact matches."""
    kept = top_per_key(df.select(*keys, "id").distinct(), keys, [F.col("id")], 3)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias(name))


def _containing_orgs(new_groups: DataFrame, known_groups: DataFrame) -> DataFrame:
    """Pairs (new organisation, known organisation) of one name where one holds the other."""
    fresh = new_groups.where("org_key <> ''").select("name_key", F.col("org_key").alias("new_org"))
    held = known_groups.where("org_key <> ''").select("name_key", F.col("org_key").alias("known_org"))
    inside = contained(held, fresh, ["name_key"], "known_org", "new_org").select("name_key", "new_org", "known_org")
    around = contained(fresh, held, ["name_key"], "new_org", "known_org").where("new_org <> known_org")
    return inside.unionByName(around)


def _name_groups(new: DataFrame, known: DataFrame) -> DataFrame:
    """Per distinct (name, organisation) of the upload: counts and first ids per level."""
    named = known.where("name_key <> ''")
    new_groups = new.where("name_key <> ''").select("name_key", "org_key").distinct()
    known_groups = named.groupBy("name_key", "org_key").agg(F.count("*").alias("n"))
    pairs = _containing_orgs(new_groups, known_groups)
    group_ids = _three_ids(named, ["name_key", "org_key"], "ids")
    matched = pairs.join(known_groups.withColumnRenamed("org_key", "known_org"), ["name_key", "known_org"])
    likely = matched.groupBy("name_key", "new_org").agg(F.sum("n").alias("n_likely"))
    likely_ids = _three_ids(
        pairs.join(group_ids.withColumnRenamed("org_key", "known_org"), ["name_key", "known_org"])
        .select("name_key", "new_org", F.explode("ids").alias("id")),
        ["name_key", "new_org"], "ids_likely")
    per_name = known_groups.groupBy("name_key").agg(
        F.sum("n").alias("n_all"), F.sum(F.when(F.col("org_key") == "", F.col("n")).otherwise(0)).alias("n_blank"))
    blank_ids = group_ids.where("org_key = ''").select("name_key", F.col("ids").alias("ids_blank"))
    all_ids = _three_ids(group_ids.select("name_key", F.explode("ids").alias("id")), ["name_key"], "ids_all")
    bare = F.col("org_key") == ""
    none = F.array().cast("array<string>")
    return (
        new_groups.join(per_name, "name_key").join(all_ids, "name_key").join(blank_ids, "name_key", "left")
        .join(likely.withColumnRenamed("new_org", "org_key"), ["name_key", "org_key"], "left")
        .join(likely_ids.withColumnRenamed("new_org", "org_key"), ["name_key", "org_key"], "left")
        .select(
            "name_key", "org_key", F.coalesce("n_likely", F.lit(0)).alias("n_likely"),
            F.when(bare, F.col("n_all")).otherwise(F.col("n_blank")).alias("n_unclear"),
            F.when(bare, F.lit(0)).otherwise(
                F.col("n_all") - F.col("n_blank") - F.coalesce("n_likely", F.lit(0))).alias("n_unlikely"),
            F.coalesce("ids_likely", none).alias("ids_likely"),
            F.when(bare, F.col("ids_all")).otherwise(F.coalesce("ids_blank", none)).alias("ids_unclear"))
    )


def _level(a_org: Column, b_org: Column) -> Column:
    """Confidence of a shared name given both organisation keys."""
    holds = F.contains(a_org, b_org) | F.contains(b_org, a_org)
    return (
        F.when((a_org == "") | (b_org == ""), F.lit(UNCLEAR)).when(holds, F.lit(LIKELY)).otherwise(F.lit(UNLIKELY))
    )


def find_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """Summary of all matches of the upload, e-mail before URL before name: a row per new row, type and level.

    Returns new_id, match_type, confidence, n_existing and existing_id, the first of them. The
    lowest name level carries the count only (existing_id is null there);
    :func:`duplicate_tables` names every known row.
    """
    new, known = _keyed(new), _keyed(known, "dataset_id", "pos")

    def looked_up(key: str, prefix: str) -> DataFrame:
        return _index(known, key).select(
            key, F.col("id").alias(f"{prefix}_id"), F.col("name_key").alias(f"{prefix}_name"),
            F.col("org_key").alias(f"{prefix}_org"))

    joined = (
        new.select("id", "email_key", "url_key", "name_key", "org_key")
        .join(looked_up("email_key", "e"), "email_key", "left")
        .join(looked_up("url_key", "u"), "url_key", "left")
        .join(_name_groups(new, known), ["name_key", "org_key"], "left")
    )
    e_id, u_id = F.col("e_id"), F.col("u_id")
    same = u_id.eqNullSafe(e_id)

    def taken(level: float) -> Column:
        """How many known rows of a level the exact matches have used up."""
        def one(prefix: str) -> Column:
            hit = (F.col(f"{prefix}_name") == F.col("name_key")) & (F.col("name_key") != "") & (
                _level(F.col("org_key"), F.col(f"{prefix}_org")) == level)
            return F.coalesce(hit, F.lit(False)).cast("long")
        return one("e") + F.when(same, F.lit(0)).otherwise(one("u"))

    def left_over(ids: str) -> Column:
        free = F.filter(F.col(ids), lambda i: (i != F.coalesce(e_id, F.lit(""))) & (i != F.coalesce(u_id, F.lit(""))))
        return F.get(free, 0)

    def row(kind: str, level: float, n: Column, ident: Column) -> Column:
        return F.struct(F.lit(kind).alias("match_type"), F.lit(level).alias("confidence"),
                        n.cast("long").alias("n_existing"), ident.alias("existing_id"))

    rows = F.array(
        row("email", SURE, e_id.isNotNull(), e_id),
        row("linkedin", SURE, u_id.isNotNull() & ~same, u_id),
        row("name_org", LIKELY, F.col("n_likely") - taken(LIKELY), left_over("ids_likely")),
        row("name_org", UNCLEAR, F.col("n_unclear") - taken(UNCLEAR), left_over("ids_unclear")),
        row("name_org", UNLIKELY, F.col("n_unlikely") - taken(UNLIKELY), F.lit(None).cast("string")),
    )
    return joined.select(F.col("id").alias("new_id"), F.inline(F.filter(rows, lambda r: r["n_existing"] > 0)))


class DuplicateTables(NamedTuple):
    """All matches of an upload without a row per pair; :func:`expanded` makes the pairs.

    ``exact``: new_id, existing_id, match_type ("email" or "linkedin"), at most two rows per new
    row. ``new_members`` and ``known_members``: ids with their group, a name and organisation.
    ``links``: new_group, known_group and confidence. A known_group that is null stands for all
    known groups of the name that no other link of the new group reaches, at the lowest level:
    the only level whose pairs of groups could outgrow the tables.
    """

    exact: DataFrame
    new_members: DataFrame
    links: DataFrame
    known_members: DataFrame


def _group(name: str | Column, org: str | Column) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in (("name_key", name), ("org_key", org))])


def duplicate_tables(new: DataFrame, known: DataFrame, stored: bool = False) -> DuplicateTables:
    """Every match of the upload with the known people, as groups of rows that match alike.

    Rows meet by e-mail and URL (the last known row of a key), and by name: at 0.9 if one
    organisation holds the other, at 0.6 if either has none, else at 0.5. A row without a name
    is in no group. Nothing is computed before one of the tables is read, unless ``stored``:
    then the match keys are worked out at once, for who reads them all.
    """
    fresh, held = (_keyed(new), _keyed(known, "dataset_id", "pos")) if stored else (with_match_keys(new), with_match_keys(known))
    exact = _exact(fresh, held, "email_key", "email").unionByName(_exact(fresh, held, "url_key", "linkedin"))
    # Where e-mail and URL lead to one known row, e-mail has it.
    exact = exact.groupBy("new_id", "existing_id").agg(F.min("match_type").alias("match_type"))
    new_groups = fresh.where("name_key <> ''").select("name_key", "org_key").distinct()
    known_groups = held.where("name_key <> ''").select("name_key", "org_key").distinct()
    mine, theirs = _group("name_key", "org_key").alias("new_group"), _group("name_key", "known_org").alias("known_group")
    likely = _containing_orgs(new_groups, known_groups).select(
        _group("name_key", "new_org").alias("new_group"), theirs, F.lit(LIKELY).alias("confidence"))
    other = known_groups.select("name_key", F.col("org_key").alias("known_org"))
    # A name has one group without an organisation at most, so these grow with the groups only.
    bare = new_groups.where("org_key = ''").join(other, "name_key").unionByName(
        new_groups.where("org_key <> ''").join(other.where("known_org = ''"), "name_key"))
    unclear = bare.select(mine, theirs, F.lit(UNCLEAR).alias("confidence"))
    reached = likely.groupBy("new_group").agg(F.count("*").alias("reached"))
    filled = known_groups.where("org_key <> ''").groupBy("name_key").agg(F.count("*").alias("filled"))
    rest = new_groups.where("org_key <> ''").join(filled, "name_key").select(mine, "filled").join(reached, "new_group", "left").where(
        F.col("filled") > F.coalesce("reached", F.lit(0)))
    unlikely = rest.select("new_group", F.lit(None).cast("struct<name_key: string, org_key: string>").alias("known_group"), F.lit(UNLIKELY).alias("confidence"))
    return DuplicateTables(
        exact, fresh.where("name_key <> ''").select(F.col("id").alias("new_id"), mine),
        likely.unionByName(unclear).unionByName(unlikely),
        held.where("name_key <> ''").select(_group("name_key", "org_key").alias("known_group"), F.col("id").alias("existing_id")))


def expanded(tables: DuplicateTables) -> DataFrame:
    """new_id, existing_id, match_type and confidence of every pair, each pair once, e-mail and URL first.

    As many rows as there are pairs: for uploads of a reviewable size, or joined with a filter.
    The last join meets a new row with lists of the known ids of its name, a list per
    organisation, so that it settles a level once per list; the lists are taken apart behind it
    and pairs moved no more. A list brings the levels of the links that name it along, a new row
    the known rows that it met by e-mail or URL, by the list that has them. A name is cut into
    slices of new and parts of known rows, whatever their organisations, so one name is many
    tasks and a new row makes no more pairs at a time than a part has rows.
    """
    links, exact = cut_lineage(tables.links), cut_lineage(tables.exact)
    mine = tables.new_members.select(F.col("new_group.name_key"), F.col("new_group.org_key").alias("_new_org"), "new_id")
    theirs = tables.known_members.select(F.col("known_group.name_key"), F.col("known_group.org_key").alias("_org"), "existing_id")
    names = cut_lineage(mine.groupBy("name_key").agg(F.count("*").alias("_n")).join(
        theirs.groupBy("name_key").agg(F.count("*").alias("_k")), "name_key").select(
        "name_key", F.ceil(F.col("_n") / SLICE).cast("int").alias("_slices"), F.ceil(F.col("_k") / PART).cast("int").alias("_parts"),
        (F.col("_n").cast("double") * F.col("_k")).alias("_pairs")))
    tasks = int(min(TASKS, 1 + (names.agg(F.sum("_pairs")).first()[0] or 0) // TASK))
    # The level of all known groups of the name that no link of the new group names.
    others = links.where("known_group IS NULL").select(
        F.col("new_group.name_key"), F.col("new_group.org_key").alias("_new_org"), F.col("confidence").alias("_other"))
    sliced = mine.join(names, "name_key").withColumn("_slice", F.pmod(F.xxhash64("new_id"), F.col("_slices")).cast("int"))
    levels = links.where("known_group IS NOT NULL").select(
        F.col("new_group.name_key"), F.col("new_group.org_key").alias("_new_org"), F.col("known_group.org_key").alias("_org"), "confidence").join(
        sliced.select("name_key", "_new_org", "_slice").distinct(), ["name_key", "_new_org"]).groupBy("name_key", "_org", "_slice").agg(
        F.map_from_entries(F.collect_list(F.struct("_new_org", "confidence"))).alias("_levels"))
    # Rows of one id are dealt out by their number, so that no list outgrows a part.
    dealt = theirs.groupBy("name_key", "_org", "existing_id").agg(F.count("*").cast("int").alias("_n")).join(names, "name_key").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(
        "name_key", "_org", "existing_id", "_slices", F.pmod(F.xxhash64("existing_id", "_copy"), F.col("_parts")).cast("int").alias("_part"))
    lists = dealt.groupBy("name_key", "_part", "_org", "_slices").agg(
        F.collect_list(F.struct("existing_id")).getField("existing_id").alias("_ids"))
    met = exact.join(dealt.select("name_key", "_org", "_part", "existing_id").distinct(), "existing_id").groupBy(
        "new_id", "name_key", "_part", "_org").agg(F.collect_list("existing_id").alias("_met")).groupBy("new_id", "name_key").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("_part", "_org"), "_met"))).alias("_met"))
    spread = ["name_key", "_slice", "_part"]
    asked = lists.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).join(
        levels, ["name_key", "_org", "_slice"], "left").select(*spread, "_org", "_ids", "_levels").repartition(tasks, *spread)
    asking = sliced.join(met, ["new_id", "name_key"], "left").join(others, ["name_key", "_new_org"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        *spread, "_new_org", "new_id", "_met", "_other").repartition(tasks, *spread)
    # A merge join reads its left side row by row; the other way round a list would meet a whole slice at once.
    by_name = asking.join(asked.hint("merge"), spread).withColumn(
        "confidence", F.coalesce(F.element_at("_levels", F.col("_new_org")), F.col("_other"))).where("confidence IS NOT NULL").select(
        "new_id", F.element_at("_met", F.struct("_part", "_org")).alias("_here"), "confidence", F.explode("_ids").alias("existing_id")).where(
        ~F.coalesce(F.array_contains("_here", F.col("existing_id")), F.lit(False))).select(
        "new_id", "existing_id", F.lit("name_org").alias("match_type"), "confidence")
    return exact.select("new_id", "existing_id", "match_type", F.lit(SURE).alias("confidence")).unionByName(by_name)


def match_by_name(new: DataFrame, known: DataFrame) -> DataFrame:
    """Known rows per new row that share its name, counted by confidence level."""
    new, known = _keyed(new), _keyed(known, "dataset_id", "pos")
    groups = _name_groups(new, known)
    return new.where("name_key <> ''").join(groups, ["name_key", "org_key"]).select(
        F.col("id").alias("new_id"), "n_likely", "n_unclear", "n_unlikely",
        F.get("ids_likely", 0).alias("first_likely"), F.get("ids_unclear", 0).alias("first_unclear"))


def mark_duplicates(new: DataFrame, known: DataFrame, at_least: float = LIKELY) -> DataFrame:
    """The upload with pending rows marked enriched where a definite duplicate exists."""
    sure = find_duplicates(new, known).where(F.col("confidence") >= at_least)
    best = sure.groupBy("new_id").agg(F.max("confidence").alias("duplicate_confidence"))
    joined = new.join(best, new["id"] == best["new_id"], "left").drop("new_id")
    found = F.col("duplicate_confidence").isNotNull() & (F.col("enrichment_status") == "pending")
    return joined.withColumn("already_enriched", found).withColumn(
        "enrichment_status", F.when(found, "enriched").otherwise(F.col("enrichment_status")))


def already_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the upload whose URL or e-mail occurs among the known people."""
    url, mail = loose_url_key(F.col("linkedin_url")), F.lower(text("email"))
    keyed = new.withColumns({"_url": url, "_mail": mail})
    known_urls = known.select(url.alias("_url")).where("_url <> ''").distinct().withColumn("_u", F.lit(True))
    known_mails = known.select(mail.alias("_mail")).where("_mail <> ''").distinct().withColumn("_m", F.lit(True))
    hit = F.coalesce("_u", F.lit(False)) | F.coalesce("_m", F.lit(False))
    return keyed.join(known_urls, "_url", "left").join(known_mails, "_mail", "left").where(hit).select(*new.columns)


def group_key(email: Column, url: Column, name: Column, org: Column) -> Column:
    """Most trusted identity of a row; empty when it has none."""
    mail, link = F.lower(trim_all(email)), F.regexp_replace(F.lower(trim_all(url)), "/+$", "")
    who, firm = F.lower(trim_all(name)), F.lower(trim_all(org))
    return (
        F.when(mail != "", F.concat(F.lit("email:"), mail)).when(link != "", F.concat(F.lit("li:"), link))
        .when(who != "", F.concat(F.lit("name:"), who, F.lit("|"), firm)).otherwise("")
    )


def person_id(account: Column, email: Column, url: Column, name: Column, org: Column, row_id: Column) -> Column:
    key = group_key(email, url, name, org)
    owned = first_filled(key, F.concat(F.lit("none:"), row_id))
    return F.left(F.md5(F.concat(account, F.lit(":"), owned)), F.lit(12))


def with_person_id(df: DataFrame) -> DataFrame:
    """Rows with a person_id where they had none."""
    fresh = person_id(*[F.col(c) for c in ("account_id", "email", "linkedin_url", "name", "organization", "id")])
    had = F.col("person_id") if "person_id" in df.columns else F.lit("")
    return df.withColumn("person_id", first_filled(had, fresh))


def persons_per_account(df: DataFrame) -> DataFrame:
    """Rows against distinct persons; a two-step count keeps a large account spread out."""
    per_person = with_person_id(df).groupBy("account_id", "person_id").agg(F.count("*").alias("n"))
    return per_person.groupBy("account_id").agg(F.sum("n").alias("rows"), F.count("*").alias("persons"))


def linked_persons(df: DataFrame) -> DataFrame:
    """Transitive groups: rows that share any key end in one group (id, group_id).

    Smallest label wins. Rows and keys form a two-sided graph, so a key shared by a third
    of the rows is one aggregate and not a clique. Labels only fall, so the rounds end.
    """
    mail, link = F.lower(trim_all(F.col("email"))), F.regexp_replace(F.lower(trim_all(F.col("linkedin_url"))), "/+$", "")
    who = F.lower(trim_all(F.col("name")))
    keys = F.array_compact(F.array(
        F.when(mail != "", F.concat(F.lit("email:"), mail)), F.when(link != "", F.concat(F.lit("li:"), link)),
        F.when(who != "", F.concat(F.lit("name:"), who, F.lit("|"), F.lower(trim_all(F.col("organization")))))))
    edges = cut_lineage(df.select("id", F.explode(keys).alias("key")).distinct())
    labels = cut_lineage(df.select("id", F.col("id").alias("label")))
    while True:
        by_key = edges.join(labels, "id").groupBy("key").agg(F.min("label").alias("label"))
        offered = edges.join(by_key, "key").groupBy("id").agg(F.min("label").alias("offer"))
        moved = labels.join(offered, "id", "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("next"), "label")
        # Pointer jump: follow the label's own label, which halves long chains.
        targets = moved.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        stepped = cut_lineage(
            moved.join(targets, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("label"),
                                                       F.col("label").alias("before")))
        if stepped.where("label <> before").isEmpty():
            return stepped.select("id", F.col("label").alias("group_id"))
        labels = stepped.select("id", "label")


def shared_urls(df: DataFrame) -> DataFrame:
    """Profile URLs assigned to more than one row."""
    keyed = df.select("id", loose_url_key(F.col("linkedin_url")).alias("url_key")).where("url_key <> ''")
    return keyed.groupBy("url_key").agg(F.count("*").alias("n_profiles"), F.min("id").alias("first_id")).where("n_profiles > 1")

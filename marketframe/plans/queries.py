"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the whole given tables (through the
bindings in ``marketframe.sources.bindings``).  Parameters that a request
would carry (search text, filters, k, page) are fixed values below."""

from __future__ import annotations

import datetime as _dt
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import semantics as sem
from marketframe.operators import accounts as acc
from marketframe.operators import catalog as cat
from marketframe.operators import changes as ch
from marketframe.operators import inventory as inv
from marketframe.operators import lockout as lk
from marketframe.operators import multi_search as ms
from marketframe.operators import search as se
from marketframe.operators import tournaments as tn
from marketframe.session import checkpoint_dir
from marketframe.sources import bindings as b
from marketframe.sources.feed_split import read_feed_split
from marketframe.streaming import inventory_stream as ist

# Fixed request parameters of the registered queries.
SEARCH_OFFERS = "ro"          # my-inventory search text
CONDITION = "R"
LANGUAGE = "F"
PRICE_MAX = "50000.5abc"      # parseFloat -> 50000.5
NAME_PATTERN = "r_d"          # '_' stays a wildcard: red, rod
TOP_K = 20
BEST_K = 3
PAGE_SIZE = 50
SELLER_SEARCH = "gear"
CARD_SEARCH = "ring"
SELLER_TEXT = "1"
PAGE_LIMIT, PAGE_OFFSET = 20, 5
LOG_BUCKETS = 16
LOCK_LENGTH = _dt.timedelta(days=1)  # a user has an attempt every ~11 hours

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- shared derivations ----------------------------------------------------------
def _detail(spark, d):
    return inv.inventory_detail(b.inventario(spark, d), b.cards(spark, d), b.vendedores(spark, d))


def _base_and_changes(spark, d):
    lines = b.inventory_lines(spark, d)
    cutoff = sem.ntz_lit(b.CUTOFF)
    base = b.inventario(spark, d, before=b.CUTOFF)
    return base, lines.where(F.col("at") >= cutoff)


def _feed_tables(spark, d):
    f = b.feed(spark, d)
    return (cat.shred_cards(f), cat.shred_types(f), cat.shred_printings(f),
            cat.shred_banlist(f), cat.shred_images(f), cat.shred_prices(f))


def _admission(spark, d):
    t = b.tournaments(spark, d)
    players = b.stored_players(spark, d)
    out = tn.admit_players(t, players, b.tournament_joins(spark, d))
    return t, players, out


def _text(arr, fmt) -> F.Column:
    return F.array_join(F.transform(arr, fmt), "|")


def _nz(c) -> F.Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                      F.lit("~"))


# ---- sources / scans -------------------------------------------------------------
@query
def q_scan_tournaments(spark, d):
    return b.tournaments(spark, d)


@query
def q_inventory_detail(spark, d):
    return _detail(spark, d)


def _admitted_users(spark, d):
    """Registration requests that the batch admission accepted."""
    regs = b.user_registrations(spark, d)
    accepted = acc.register_users(regs, b.users(spark, d)).where("status = 'accepted'").select("seq")
    return regs.join(accepted, "seq", "left_semi")


@query
def q_append_rows(spark, d):
    rows = _admitted_users(spark, d).select(
        (-1 - F.col("seq")).alias("id"), "username",  # below every stored id
        F.lit(None).cast("string").alias("password_hash"), "email", "dni",
        F.coalesce(sem.falsy_to_null("user_type"), F.lit("cliente")).alias("user_type"),
        F.lit(True).alias("is_active"), sem.ntz_lit(b.NOW).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return ch.append_rows(b.users(spark, d), rows).new_state


@query
def q_ingest_report(spark, d):
    return cat.ingest_report(b.feed(spark, d))


@query
def q_ingest_catalog(spark, d):
    """A later feed delivery (cards with sets shipped from the cutoff on)
    applied to the stored catalog as its next version; all rows of the six
    tables, each as its columns' text."""
    f = b.feed(spark, d)
    c = b.cards(spark, d)
    store = cat.CatalogStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}")
    store.write(0, cat.CatalogState(
        c, c.select(F.col("id").alias("card_id"), F.col("type").alias("type_name")),
        cat.shred_printings(f),
        c.select(F.col("id").alias("card_id"),
                 F.when(F.col("level") % 4 == 0, F.lit("Limited")).alias("ban_ocg")),
        cat.shred_images(f), cat.shred_prices(f)))
    store.ingest(b.feed(spark, d, since=b.CUTOFF))
    parts = [t.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[_nz(x) for x in t.columns]).alias("row"))
             for name, t in store.read()._asdict().items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query
def q_feed_landed(spark, d):
    """Landed feed documents, each cut at card borders and read by many tasks."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    b.land_feed(b.feed(spark, d), folder)
    f = read_feed_split(spark, folder)
    cards = cat.shred_cards(f)
    sets = F.coalesce("card_sets", F.array())
    nested = f.select(
        "id", F.size(sets).alias("n_sets"),
        F.array_join(F.array_sort(F.transform(sets, lambda s: F.concat_ws(
            "/", _nz(s["set_code"]), _nz(s["set_rarity_code"]), _nz(s["set_price"])))), "|").alias("sets"),
        F.array_join(F.coalesce("typeline", F.array().cast("array<string>")), "|").alias("types"),
        F.col("banlist_info").isNotNull().alias("has_banlist"))
    return cards.join(nested, "id")


@query
def q_unnest_zip(spark, d):
    f = b.feed(spark, d)
    arrays = f.select("id", F.coalesce("typeline", F.array().cast("array<string>")).alias("a"),
                      F.transform(F.array_sort(F.coalesce("card_sets", F.array())),
                                  lambda s: s["set_name"]).alias("b"))
    return cat.unnest_zip(arrays, {"a": "type_name", "b": "set_name"}, keep=["id"])


@query
def q_array_casts(spark, d):
    """Arrays of text, cast to typed arrays and zipped into rows."""
    key, user = F.col("o_orderkey"), F.col("o_custkey")
    arrays = b.read_table(spark, d, "orders").select(
        "o_orderkey", F.array(key.cast("string"), F.lit("12")).alias("ids"),
        F.array(F.concat(user.cast("string"), F.lit(".25")), F.lit(None).cast("string"), F.lit(" 7.5 ")).alias("prices"),
        F.when(key % 3 == 0, F.array((key % 100).cast("string"))).alias("levels"))
    return cat.unnest_zip(arrays, {"ids": "card_id", "prices": "price", "levels": "level"},
                          types={"ids": "bigint", "prices": "decimal(12,2)", "levels": "int"}, keep=["o_orderkey"])


# ---- projections / filters -----------------------------------------------------------
@query
def q_seller_public(spark, d):
    return acc.seller_public(b.vendedores(spark, d))


@query
def q_seller_by_konami(spark, d):
    ids = b.seller_registrations(spark, d).select("konami_id")
    return acc.seller_by_konami(b.vendedores(spark, d), ids)


@query
def q_my_inventory(spark, d):
    s = b.vendedores(spark, d).select("vendedor_id")
    return inv.my_inventory(b.inventario(spark, d), b.cards(spark, d), s, condicion=CONDITION,
                            search=SEARCH_OFFERS, orden="name")


@query
def q_my_inventory_by_price(spark, d):
    return inv.my_inventory(b.inventario(spark, d), b.cards(spark, d), idioma=LANGUAGE,
                            orden="precio")


@query
def q_user_lookup(spark, d):
    regs = b.user_registrations(spark, d)
    logins = regs.select(F.col("email").alias("login")).unionByName(
        b.users(spark, d).select(F.col("username").alias("login"))).distinct()
    return acc.user_lookup(b.users(spark, d), logins)


@query
def q_login_check(spark, d):
    """Users by login name with status and roles."""
    logins = b.user_registrations(spark, d).select(F.col("email").alias("login")).unionByName(
        b.users(spark, d).select(F.col("username").alias("login"))).distinct()
    hits = acc.login_check(b.users(spark, d), b.user_roles(spark, d), logins)
    return hits.withColumn("roles", F.array_join("roles", ","))


@query
def q_user_conflicts(spark, d):
    return acc.user_conflicts(b.user_registrations(spark, d), b.users(spark, d))


@query
def q_seller_search_page(spark, d):
    return acc.seller_search_page(b.vendedores(spark, d), SELLER_TEXT, PAGE_LIMIT, PAGE_OFFSET)


@query
def q_card_offers(spark, d):
    ids = b.cards(spark, d).select("id")
    return inv.card_offers(_detail(spark, d), ids, idioma=LANGUAGE, precio_max=PRICE_MAX)


@query
def q_active_seller_count(spark, d):
    return acc.active_seller_count(b.vendedores(spark, d))


@query
def q_semi_by_keys(spark, d):
    found = se.search_cards(b.cards(spark, d), CARD_SEARCH).select("id")
    _, _, printings, _, _, _ = _feed_tables(spark, d)
    return se.semi_by_keys(printings, found)


@query
def q_semi_exists(spark, d):
    sellers = b.user_roles(spark, d).where(F.col("role") == acc.SELLER_ROLE)
    u = b.users(spark, d)
    return u.join(sellers, u.id == sellers.user_id, "left_semi").select("id", "username")


@query
def q_anti_missing(spark, d):
    u = b.users(spark, d)
    r = b.user_roles(spark, d).where(F.col("role") == "admin")
    return u.join(r, u.id == r.user_id, "left_anti").select("id", "username")


@query
def q_validate_users(spark, d):
    return acc.validate_users(b.user_registrations(spark, d)).select("seq", "error")


@query
def q_role_filter(spark, d):
    wr = acc.user_roles(b.users(spark, d), b.user_roles(spark, d))
    return acc.role_filter(wr).select("id", "username", F.array_join("roles", ",").alias("roles"))


@query
def q_bulk_upsert(spark, d):
    base, lines = _base_and_changes(spark, d)
    return ch.bulk_upsert(base, lines, now=b.NOW).new_state


@query
def q_bulk_requests(spark, d):
    """Bulk requests as they come, arrays of lines; the rows they touch."""
    lines, _ = ch.explode_bulk_requests(b.bulk_requests(spark, d))
    res = ch.bulk_upsert(b.inventario(spark, d), lines, now=b.NOW)
    return res.affected.select("vendedor_id", "card_id", "cantidad", "precio", "condicion", "idioma", "edicion")


@query
def q_bulk_requests_rejected(spark, d):
    """Requests without an array, lines without a card."""
    lines, refused = ch.explode_bulk_requests(b.bulk_requests(spark, d))
    _, skipped = ch.valid_lines(lines)
    return refused.select("seq", F.lit(None).cast("int").alias("line"), "vendedor_id", "reason").unionByName(
        skipped.select(F.col("seq._req").alias("seq"), F.col("seq._pos").alias("line"), "vendedor_id", "reason"))


@query
def q_inventory_log(spark, d):
    """The change log applied in micro-batches, one a year of arrival,
    to the log-structured inventory; the first one is delivered twice."""
    base, lines = _base_and_changes(spark, d)
    log = ist.inventory_log(spark, f"{checkpoint_dir(spark).rstrip('/')}/inventory-{uuid.uuid4().hex}", LOG_BUCKETS)
    log.create(base)
    year = F.year("at")
    apply = ist.apply_bulk_batches(log, lambda _: b.NOW)
    years = sorted(r[0] for r in lines.select(year).distinct().collect())  # a few numbers
    for batch_id in [*years[:1], *years]:
        apply(lines.where(year == batch_id), batch_id)
    return log.read()


# ---- joins ---------------------------------------------------------------------------
def _flat_doc(doc: DataFrame) -> DataFrame:
    return doc.select(
        "id", "name", "type", "humanReadableCardType", "frameType", "desc", "race", "atk",
        "def", "level", "attribute", "archetype", "ygoprodeck_url",
        F.array_join("typeline", "|").alias("typeline"),
        _text("card_sets", lambda s: F.concat_ws("/", _nz(s["set_name"]), _nz(s["set_code"]),
                                                 _nz(s["set_rarity"]), _nz(s["set_rarity_code"]),
                                                 _nz(s["set_price"]))).alias("card_sets"),
        F.col("banlist_info").isNotNull().alias("has_banlist"),
        F.col("banlist_info.ban_ocg").alias("ban_ocg"),
        _text("card_images", lambda s: F.concat_ws("/", _nz(s["id"]), _nz(s["image_url"]),
                                                   _nz(s["image_url_small"]),
                                                   _nz(s["image_url_cropped"]))).alias("card_images"),
        _text("card_prices", lambda s: F.concat_ws("/", *[_nz(s[p]) for p in cat.PRICE_FIELDS]))
        .alias("card_prices"))


def _nested_search(spark, d):
    cards, types, printings, banlist, images, prices = _feed_tables(spark, d)
    return se.search_nested(cards, types, printings, banlist, images, prices, CARD_SEARCH)


@query
def q_search_nested(spark, d):
    return _flat_doc(_nested_search(spark, d))


@query
def q_search_nested_json(spark, d):
    return se.to_json_documents(_nested_search(spark, d))


@query
def q_user_roles(spark, d):
    wr = acc.user_roles(b.users(spark, d), b.user_roles(spark, d))
    return wr.select("id", "username", "user_type", "is_active",
                     F.array_join("roles", ",").alias("roles"))


def _inventory_updates(spark, d):
    i = b.inventario(spark, d)
    return i.select(
        "inventario_id",
        F.when(F.col("card_id") % 5 == 0, F.col("vendedor_id") + 1)
         .otherwise(F.col("vendedor_id")).alias("vendedor_id"),
        F.when(F.col("cantidad") % 4 != 0, F.col("cantidad") * 2).alias("cantidad"),
        F.when(F.col("card_id") % 3 == 0, F.lit(0).cast("decimal(12,2)"))
         .when(F.col("card_id") % 3 == 1, F.col("precio") + 1).alias("precio"),
        F.when(F.col("card_id") % 2 == 0, F.lit("")).alias("condicion"),
        F.lit(None).cast("string").alias("idioma"),
        F.when(F.col("edicion").isNull(), F.lit("1st")).alias("edicion"),
        F.lit(None).cast("string").alias("notas"))


@query
def q_guarded_update(spark, d):
    cols = ["cantidad", "precio", "condicion", "idioma", "edicion", "notas"]
    return ch.guarded_update(b.inventario(spark, d), _inventory_updates(spark, d),
                             "inventario_id", "vendedor_id", cols).new_state


# ---- aggregations ---------------------------------------------------------------------
@query
def q_card_count(spark, d):
    return b.cards(spark, d).agg(F.count(F.lit(1)).alias("total_cards"))


@query
def q_tournament_counts(spark, d):
    t, players, out = _admission(spark, d)
    _, new_players = tn.apply_admissions(t, players, out)
    return tn.player_counts(new_players)


@query
def q_inventory_stats(spark, d):
    return inv.inventory_stats(b.inventario(spark, d), b.vendedores(spark, d).select("vendedor_id"))


@query
def q_inventory_stats_one(spark, d):
    return inv.inventory_stats_total(b.inventario(spark, d))


@query
def q_nest_types(spark, d):
    _, types, *_ = _feed_tables(spark, d)
    return se.nest_types(types).select("card_id", F.array_join("typeline", "|").alias("typeline"))


@query
def q_nest_printings(spark, d):
    _, _, printings, *_ = _feed_tables(spark, d)
    n = se.nest_printings(printings)
    return n.select("card_id", _text("card_sets", lambda s: F.concat_ws(
        "/", _nz(s["set_name"]), _nz(s["set_code"]), _nz(s["set_rarity"]),
        _nz(s["set_rarity_code"]), _nz(s["set_price"]))).alias("card_sets"))


@query
def q_nest_images_prices(spark, d):
    _, _, _, _, images, prices = _feed_tables(spark, d)
    im = se.nest_images(images)
    pr = se.nest_prices(prices)
    j = im.join(pr, "card_id", "full_outer")
    return j.select(
        "card_id",
        _text(F.coalesce("card_images", F.array()), lambda s: F.concat_ws(
            "/", _nz(s["id"]), _nz(s["image_url"]), _nz(s["image_url_small"]),
            _nz(s["image_url_cropped"]))).alias("card_images"),
        _text(F.coalesce("card_prices", F.array()), lambda s: F.concat_ws(
            "/", *[_nz(s[p]) for p in cat.PRICE_FIELDS])).alias("card_prices"))


@query
def q_nest_banlist(spark, d):
    _, _, _, banlist, _, _ = _feed_tables(spark, d)
    return se.nest_banlist(banlist).select("card_id", F.col("banlist_info.ban_ocg").alias("ban_ocg"))


@query
def q_nest_banlist_last(spark, d):
    """Of a card's many rows the last to arrive holds."""
    rows = b.inventory_lines(spark, d).select("card_id", F.col("condicion").alias("ban_ocg"), "seq")
    return se.nest_banlist(rows, "seq").select("card_id", F.col("banlist_info.ban_ocg").alias("ban_ocg"))


@query
def q_name_offers_total(spark, d):
    return inv.name_offers_total(_detail(spark, d), NAME_PATTERN, TOP_K)


@query
def q_upsert_ignore(spark, d):
    p = b.cards(spark, d)
    base = p.select(F.col("id").alias("card_id"), F.col("type").alias("type_name"))
    _, types, *_ = _feed_tables(spark, d)
    return ch.insert_ignore(base, types, ["card_id", "type_name"]).new_state


# ---- sort / limit / ordered -------------------------------------------------------------
@query
def q_seller_inventory(spark, d):
    return inv.seller_inventory(_detail(spark, d), search=SELLER_SEARCH)


@query
def q_name_offers_topk(spark, d):
    return inv.name_offers_topk(_detail(spark, d), NAME_PATTERN, TOP_K).select(
        "inventario_id", "vendedor_id", "card_id", "card_name", "precio")


@query
def q_offers_nested(spark, d):
    n = inv.offers_nested(_detail(spark, d), PAGE_SIZE)
    return n.select(
        "vendedor_id", "page", F.col("vendedor.nombre").alias("nombre"),
        F.col("vendedor.konami_id").alias("konami_id"), F.col("vendedor.whatsapp").alias("whatsapp"),
        F.col("vendedor.instagram").alias("instagram"), F.size("inventario").alias("n_items"),
        F.array_join(F.transform("inventario", lambda x: F.concat_ws(
            ":", x["line_no"].cast("string"), x["inventario_id"].cast("string"))), ",")
        .alias("items"))


@query
def q_card_offers_nested(spark, d):
    """Offers of a card under its header."""
    n = inv.offers_by_card(_detail(spark, d), PAGE_SIZE)
    return n.select("card_id", "page", F.col("carta.name").alias("name"), F.col("carta.total").alias("total"),
                    F.array_join(F.transform("ofertas", lambda x: F.concat_ws(
                        ":", x["line_no"].cast("string"), x["inventario_id"].cast("string"), _nz(x["precio"]))), ",")
                    .alias("items"))


@query
def q_bulk_running_qty(spark, d):
    base, lines = _base_and_changes(spark, d)
    return ch.bulk_running_quantities(base, lines)


@query
def q_best_offers_per_card(spark, d):
    return inv.best_offers_per_card(_detail(spark, d), BEST_K).select(
        "card_id", "rank", "inventario_id", "precio")


# ---- keyed changes ------------------------------------------------------------------------
def _card_batch(spark, d):
    c = b.cards(spark, d)
    return c.select(
        F.when(F.col("level") % 10 == 0, -1 - F.col("id")).otherwise(F.col("id"))
         .alias("id"),
        F.concat("name", F.lit(" v2")).alias("name"),
        F.concat(F.lit("NEW "), "type").alias("type"),
        "human_readable_card_type", "frame_type", F.upper("description").alias("description"),
        F.lit("Zombie").alias("race"),
        F.when(F.col("level") % 3 != 0, F.col("atk") + 1).alias("atk"),
        "def", "level", "attribute", "archetype",
        F.concat("ygoprodeck_url", F.lit("/new")).alias("ygoprodeck_url"))


@query
def q_upsert_partial(spark, d):
    return ch.upsert_columns(b.cards(spark, d), _card_batch(spark, d), ["id"],
                             cat.CARD_UPDATE_COLUMNS).new_state


@query
def q_batch_duplicates(spark, d):
    _, types, *_ = _feed_tables(spark, d)
    return ch.check_unique(types, ["card_id", "type_name"])


@query
def q_upsert_additive(spark, d):
    base, lines = _base_and_changes(spark, d)
    return ch.upsert_additive(base, lines, now=b.NOW, cards=b.cards(spark, d)).new_state


@query
def q_upsert_banlist(spark, d):
    c = b.cards(spark, d)
    base = c.select(F.col("id").alias("card_id"),
                    F.when(F.col("level") % 4 == 0, F.lit("Limited")).alias("ban_ocg"))
    _, _, _, banlist, _, _ = _feed_tables(spark, d)
    return ch.upsert_columns(base, banlist, ["card_id"], ["ban_ocg"]).new_state


@query
def q_replace_children(spark, d):
    base = cat.shred_printings(b.feed(spark, d))
    batch = b.feed(spark, d, since=b.CUTOFF)
    return ch.replace_children(base, batch.select("id"), cat.shred_printings(batch)).new_state


@query
def q_coalesce_update(spark, d):
    s = b.vendedores(spark, d)
    key = F.col("vendedor_id")
    upd = s.select("vendedor_id",
                   F.when(key % 2 == 0, F.upper("nombres")).alias("nombres"),
                   F.lit(None).cast("string").alias("apellidos"),
                   F.when(key % 5 == 0, F.lit("")).alias("konami_id"),
                   F.when(key % 3 == 1, F.lit("+1")).alias("whatsapp"),
                   F.lit(None).cast("string").alias("instagram"),
                   F.when(key % 4 == 1, F.lit("fb")).alias("facebook"),
                   F.lit(None).cast("string").alias("otro"))
    cols = ["nombres", "apellidos", "konami_id", "whatsapp", "instagram", "facebook", "otro"]
    res = ch.coalesce_update(s, upd, ["vendedor_id"], cols)
    return res.new_state.select("vendedor_id", *cols)


@query
def q_guarded_delete(spark, d):
    i = b.inventario(spark, d)
    dels = i.where(F.col("precio").isNull()).select(
        "inventario_id",
        F.when(F.col("card_id") % 4 == 0, F.col("vendedor_id") + 1)
         .otherwise(F.col("vendedor_id")).alias("vendedor_id"))
    return ch.guarded_delete(i, dels, "inventario_id", "vendedor_id").new_state


@query
def q_set_results(spark, d):
    t, players, out = _admission(spark, d)
    _, new_players = tn.apply_admissions(t, players, out)
    return tn.set_results(new_players, b.tournament_results(spark, d)).new_state


@query
def q_touch_rows(spark, d):
    users = b.users(spark, d)
    logins = b.user_registrations(spark, d).select(F.col("email").alias("login"))
    ok = acc.user_lookup(users, logins).where(F.col("status") == "ok").select("id")
    return ch.touch_rows(users, ok, "id", "updated_at", now=b.NOW).new_state.select(
        "id", "username", "updated_at")


@query
def q_refresh_counts(spark, d):
    t, players, out = _admission(spark, d)
    new_t, _ = tn.apply_admissions(t, players, out)
    return new_t


@query
def q_upgrade_sellers(spark, d):
    u = b.users(spark, d)
    new_users, new_roles, refused = acc.upgrade_to_seller(u, b.user_roles(spark, d),
                                                           u.select("id"), now=b.NOW)
    r = new_roles.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",")
                                         .alias("roles"))
    return (new_users.join(r, new_users.id == r.user_id, "left")
                     .select("id", "user_type", "updated_at", "roles"))


# ---- scalar functions -------------------------------------------------------------------
@query
def q_feed_shred_cards(spark, d):
    return cat.shred_cards(b.feed(spark, d))


@query
def q_feed_shred_types(spark, d):
    return cat.shred_types(b.feed(spark, d))


@query
def q_feed_shred_printings(spark, d):
    return cat.shred_printings(b.feed(spark, d))


@query
def q_feed_shred_banlist(spark, d):
    return cat.shred_banlist(b.feed(spark, d))


@query
def q_feed_shred_images(spark, d):
    return cat.shred_images(b.feed(spark, d))


@query
def q_feed_shred_prices(spark, d):
    return cat.shred_prices(b.feed(spark, d))


@query
def q_parse_price(spark, d):
    f = b.feed(spark, d)
    s = f.select("id", F.inline("card_sets"))
    return s.select("id", "set_code", F.col("set_price").alias("price_text"),
                    sem.parse_float("set_price").alias("parsed"),
                    sem.parse_float_or_zero("set_price").alias("stored"))


@query
def q_parse_int(spark, d):
    t = b.tournaments(spark, d).select(F.col("id").alias("k"), F.col("maxPlayers").alias("text"))
    s = b.feed(spark, d).select("id", F.inline("card_sets")).select(
        F.col("id").alias("k"), F.col("set_price").alias("text"))
    both = t.unionByName(s)
    return both.select("k", "text", sem.parse_int("text").alias("parsed"))


@query
def q_falsy_defaults(spark, d):
    lines = b.inventory_lines(spark, d)
    return lines.select(
        "vendedor_id", "card_id", "at", F.col("seq.l_orderkey").alias("l_orderkey"),
        F.col("seq.l_linenumber").alias("l_linenumber"),
        sem.falsy_default("cantidad", 1, "number").alias("cantidad"),
        sem.falsy_to_null("precio", "number").alias("precio"),
        sem.falsy_default("condicion", ch.DEFAULT_CONDITION).alias("condicion"),
        sem.falsy_default("idioma", ch.DEFAULT_LANGUAGE).alias("idioma"),
        sem.falsy_to_null("edicion").alias("edicion"))


@query
def q_validate_sellers(spark, d):
    return acc.validate_sellers(b.seller_registrations(spark, d)).select(
        "seq", "correo", "konami_id", "whatsapp", "otro", "error")


@query
def q_blank_names(spark, d):
    r = b.seller_registrations(spark, d)
    padded = F.when(F.col("seq") % 7 == 0, F.lit("   ")).otherwise(F.col("nombres"))
    return r.select("seq", padded.alias("nombres"), sem.is_blank(padded).alias("blank"))


@query
def q_search_cards(spark, d):
    return se.search_cards(b.cards(spark, d), CARD_SEARCH)


@query
def q_search_many_cards(spark, d):
    """P8 for all search requests at once."""
    return ms.search_many(b.cards(spark, d), ["name"], b.search_requests(spark, d))


@query
def q_search_many_sellers(spark, d):
    """P9 for many texts: pieces of seller numbers and nations."""
    texts = b.read_table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("request_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("kid"), F.col("n_nationkey").cast("string")))
         .when(F.col("n_nationkey") % 3 == 1, F.col("n_nationkey").cast("string"))
         .otherwise(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string"))).alias("text"))
    sellers = b.vendedores(spark, d).where("activo")
    return ms.search_many(sellers, ["nombres", "apellidos", "konami_id"], texts, "vendedor_id")


@query
def q_offers_many(spark, d):
    """P10 and P11 for many listings, each with its own optional filters."""
    return ms.offers_for_requests(_detail(spark, d), b.search_requests(spark, d)).select(
        "request_id", "inventario_id", "vendedor_id", "card_id", "precio")


# ---- rules ----------------------------------------------------------------------------------
@query
def q_seller_conflicts(spark, d):
    return acc.seller_conflicts(b.seller_registrations(spark, d), b.vendedores(spark, d))


@query
def q_register_batch(spark, d):
    return acc.register_users(b.user_registrations(spark, d), b.users(spark, d))


@query
def q_register_sellers(spark, d):
    return acc.register_sellers(b.seller_registrations(spark, d), b.vendedores(spark, d))


@query
def q_default_roles(spark, d):
    v = _admitted_users(spark, d)
    return acc.default_roles(v.withColumnRenamed("seq", "id")).withColumnRenamed("user_id", "seq")


@query
def q_guarded_update_affected(spark, d):
    res = ch.guarded_update(b.inventario(spark, d), _inventory_updates(spark, d), "inventario_id",
                            "vendedor_id", ["cantidad", "precio", "condicion", "edicion"])
    return res.affected.select("inventario_id", "vendedor_id", "card_id", "cantidad", "precio")


@query
def q_guarded_update_rejected(spark, d):
    res = ch.guarded_update(b.inventario(spark, d), _inventory_updates(spark, d), "inventario_id",
                            "vendedor_id", ["cantidad", "precio", "condicion", "edicion"])
    return res.rejected.select("inventario_id", "vendedor_id")


@query
def q_replace_password(spark, d):
    """One request per order; a user's last order holds."""
    o = b.read_table(spark, d, "orders")
    new = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
                   F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("password_hash"))
    return ch.set_columns(b.users(spark, d), new, ["id"], ["password_hash"], seq="seq").new_state.select(
        "id", "password_hash")


@query
def q_login_lockout(spark, d):
    outcomes, _ = lk.login_lockout(b.login_attempts(spark, d), b.vendedores(spark, d),
                                   lock=LOCK_LENGTH)
    return outcomes


@query
def q_login_lockout_sellers(spark, d):
    """The sellers' login state after the whole log."""
    _, sellers = lk.login_lockout(b.login_attempts(spark, d), b.vendedores(spark, d), lock=LOCK_LENGTH)
    return sellers.select("vendedor_id", "intentos_fallidos", "bloqueado_hasta", "ultimo_login")


@query
def q_tournament_admission(spark, d):
    _, _, out = _admission(spark, d)
    return out.select("seq", "idtournament", "outcome")

"""Declared schemas of the marketplace tables, the nested catalog feed and
the change inputs.  Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---- nested catalog feed ---------------------------------------------------
FEED_SET = _struct(("set_name", S), ("set_code", S), ("set_rarity", S),
                   ("set_rarity_code", S), ("set_price", S))
FEED_IMAGE = _struct(("image_url", S), ("image_url_small", S), ("image_url_cropped", S))
FEED_PRICE = _struct(("cardmarket_price", S), ("tcgplayer_price", S), ("ebay_price", S),
                     ("amazon_price", S), ("coolstuffinc_price", S))
FEED_CARD = _struct(
    ("id", L), ("name", S), ("type", S), ("humanReadableCardType", S), ("frameType", S),
    ("desc", S), ("race", S), ("atk", I), ("def", I), ("level", I), ("attribute", S),
    ("archetype", S), ("ygoprodeck_url", S), ("typeline", T.ArrayType(S)),
    ("card_sets", T.ArrayType(FEED_SET)), ("banlist_info", _struct(("ban_ocg", S))),
    ("card_images", T.ArrayType(FEED_IMAGE)), ("card_prices", T.ArrayType(FEED_PRICE)),
)
# The landed payload is ``{"data": [card, ...]}``.
FEED_DOCUMENT = _struct(("data", T.ArrayType(FEED_CARD)))

# ---- relational tables -----------------------------------------------------
CARDS = _struct(("id", L), ("name", S), ("type", S), ("human_readable_card_type", S),
                ("frame_type", S), ("description", S), ("race", S), ("atk", I), ("def", I),
                ("level", I), ("attribute", S), ("archetype", S), ("ygoprodeck_url", S))
CARD_TYPES = _struct(("card_id", L), ("type_name", S))
CARD_PRINTINGS = _struct(("card_id", L), ("set_name", S), ("set_code", S), ("set_rarity", S),
                         ("set_rarity_code", S), ("set_price", MONEY))
BANLIST_INFO = _struct(("card_id", L), ("ban_ocg", S))
CARD_IMAGES = _struct(("card_id", L), ("image_url", S), ("image_url_small", S),
                      ("image_url_cropped", S))
CARD_PRICES = _struct(("card_id", L), ("cardmarket_price", MONEY), ("tcgplayer_price", MONEY),
                      ("ebay_price", MONEY), ("amazon_price", MONEY), ("coolstuffinc_price", MONEY))

# cantidad is a long here: a sum of many additive changes must not overflow.
INVENTARIO = _struct(("inventario_id", L), ("vendedor_id", L), ("card_id", L), ("cantidad", L),
                     ("precio", MONEY), ("condicion", S), ("idioma", S), ("edicion", S),
                     ("notas", S), ("created_at", TS), ("updated_at", TS))
VENDEDORES = _struct(("vendedor_id", L), ("nombres", S), ("apellidos", S), ("correo", S),
                     ("password_hash", S), ("dni", S), ("konami_id", S), ("whatsapp", S),
                     ("instagram", S), ("facebook", S), ("otro", S), ("intentos_fallidos", I),
                     ("bloqueado_hasta", TS), ("ultimo_login", TS), ("created_at", TS),
                     ("updated_at", TS), ("activo", B), ("email_verificado", B))
USERS = _struct(("id", L), ("username", S), ("password_hash", S), ("email", S), ("dni", S),
                ("user_type", S), ("is_active", B), ("created_at", TS), ("updated_at", TS))
USER_ROLES = _struct(("user_id", L), ("role", S))
TOURNAMENT = _struct(("id", L), ("name", S), ("participants", I), ("maxPlayers", S))
LISTPLAYERS = _struct(("name", S), ("konamiid", S), ("idtournament", L), ("victory", I),
                      ("defeat", I), ("draw", I))

# ---- change inputs (``seq`` = arrival order) -------------------------------
INVENTORY_LINES = _struct(("seq", L), ("vendedor_id", L), ("card_id", L), ("cantidad", I),
                          ("precio", MONEY), ("condicion", S), ("idioma", S), ("edicion", S),
                          ("notas", S))
INVENTORY_UPDATES = _struct(("inventario_id", L), ("vendedor_id", L), ("cantidad", I),
                            ("precio", MONEY), ("condicion", S), ("idioma", S), ("edicion", S),
                            ("notas", S))
INVENTORY_DELETES = _struct(("inventario_id", L), ("vendedor_id", L))
SELLER_REGISTRATIONS = _struct(("seq", L), ("nombres", S), ("apellidos", S), ("correo", S),
                               ("password", S), ("dni", S), ("konami_id", S), ("whatsapp", S),
                               ("instagram", S), ("facebook", S), ("otro", S))
SELLER_PROFILE_UPDATES = _struct(("vendedor_id", L), ("nombres", S), ("apellidos", S),
                                 ("konami_id", S), ("whatsapp", S), ("instagram", S),
                                 ("facebook", S), ("otro", S))
USER_REGISTRATIONS = _struct(("seq", L), ("username", S), ("password", S), ("email", S),
                             ("dni", S), ("user_type", S))
LOGIN_ATTEMPTS = _struct(("account_id", L), ("at", TS), ("password_ok", B))
TOURNAMENT_JOINS = _struct(("seq", L), ("konamiid", S), ("name", S), ("idtournament", L))
TOURNAMENT_RESULTS = _struct(("konamiid", S), ("idtournament", L), ("victory", I),
                             ("defeat", I), ("draw", I))

# ---- the given Parquet tables (declared, so reading needs no footer job) ----
D = T.DoubleType()
DRIVER = {
    "region": _struct(("r_regionkey", I), ("r_name", S)),
    "nation": _struct(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _struct(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _struct(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _struct(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", D)),
    "orders": _struct(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _struct(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _struct(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                      ("props", S)),
}

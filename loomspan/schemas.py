"""Row types of the catalogue tables and of the raw nested payload (fixed values: the data model's names and types)."""

from __future__ import annotations

#: Fields that a raw card has itself, in order, and those that come from the first entry of its misc_info.
DIRECT = {
    "id": "bigint", "name": "string", "type": "string", "frameType": "string", "desc": "string", "race": "string", "archetype": "string",
    "atk": "bigint", "def": "bigint", "level": "bigint", "attribute": "string", "scale": "bigint", "linkval": "bigint",
}
MISC = {
    "beta_name": "string", "views": "bigint", "viewsweek": "bigint", "upvotes": "bigint", "downvotes": "bigint", "formats": "array<string>",
    "tcg_date": "string", "ocg_date": "string", "konami_id": "bigint", "has_effect": "bigint", "md_rarity": "string",
}
IMAGES = {"id": "bigint", "image_url": "string", "image_url_small": "string", "image_url_cropped": "string"}
SETS = {"set_name": "string", "set_code": "string", "set_rarity": "string", "set_rarity_code": "string", "set_price": "string"}
PRICES = {"cardmarket_price": "string", "tcgplayer_price": "string", "ebay_price": "string", "amazon_price": "string", "coolstuffinc_price": "string"}
BANS = {"ban_tcg": "string", "ban_ocg": "string", "ban_goat": "string", "ban_edison": "string"}
#: Primary keys of the catalogue tables.
KEYS = {
    "cards": ["id"], "card_images": ["card_id", "image_id"], "card_sets": ["card_id", "set_code", "set_rarity_code"],
    "card_prices": ["card_id"], "card_archetypes": ["card_id", "archetype"], "banlist_info": ["card_id"],
}


def struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{k}`: {v}" for k, v in fields.items()) + ">"


def array(fields: dict[str, str]) -> str:
    return f"array<{struct(fields)}>"


CARD = DIRECT | {
    "misc_info": array(MISC), "card_images": array(IMAGES), "card_sets": array(SETS), "card_prices": array(PRICES), "banlist_info": struct(BANS),
}
PAYLOAD = f"data {array(CARD)}"

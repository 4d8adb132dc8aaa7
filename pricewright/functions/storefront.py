"""The shop software behind a page, told by markers in its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import found

# Each marker's name and pattern.
MARKERS = (
    ("shopify.theme", r"(?i)\bShopify\.theme\b"),
    ("shopify.section", r"(?i)\bshopify-section\b"),
    ("shopify.cdn", r"(?i)cdn\.shopify\.com"),
    ("shopify.routes", r"(?i)\bShopify\.routes\b"),
    ("woocommerce", r"(?i)\bwoocommerce\b"),
    ("woocommerce.ajax", r"(?i)\bwc-ajax\b"),
    ("woocommerce.plugin", r"(?i)wp-content/plugins/woocommerce"),
    ("magento.init", r"(?i)\bx-magento-init\b"),
    ("magento.catalog", r"(?i)\bMagento_Catalog\b"),
    ("magento.mage", r"(?i)\bmage/cookies\b"),
    ("bigcommerce.stencil", r"(?i)\bstencil-utils\b"),
    ("bigcommerce.cdn", r"(?i)cdn[0-9]*\.bigcommerce\.com"),
    ("bigcommerce.context", r"(?i)\bBigCommerce\b"),
    ("state.initial", r"(?i)\b__INITIAL_STATE__\b"),
    ("state.next", r"(?i)\b__NEXT_DATA__\b"),
    ("state.nuxt", r"(?i)\b__NUXT__\b"),
    ("state.product", r"(?i)\b__PRODUCT_STATE__\b"),
    ("state.productData", r"(?i)\bproductData\b"),
    ("state.selectedVariant", r"(?i)\bselectedVariant(?:Id)?\b"),
    ("schema.product", r"""(?i)["']@type["'][ \t\n\x0B\f\r]*:[ \t\n\x0B\f\r]*["']Product["']"""),
    ("dom.product-id", r"(?i)\bdata-product-id[ \t\n\x0B\f\r]*="),
    ("dom.price", r"""(?i)\bitemprop=["']price["']"""),
)

#: The software by the start of a marker's name, first match first.
PLATFORMS = (("shopify.", "shopify"), ("woocommerce", "woocommerce"), ("magento.", "magento"), ("bigcommerce.", "bigcommerce"), ("state.", "custom"), ("dom.", "custom"), ("schema.", "custom"))


def markers(content: Column) -> Column:
    """The names of the markers in the page, sorted; a null page has none."""
    named = F.array(*(F.when(found(content, pattern), name) for name, pattern in MARKERS))
    return F.array_sort(F.array_compact(named))


def platform(names: Column) -> Column:
    """The software that a page's markers tell, else ``unknown``."""
    starts = lambda start: F.exists(names, lambda n: n.startswith(start))
    return F.coalesce(*(F.when(starts(start), kind) for start, kind in PLATFORMS), F.lit("unknown"))


def fingerprint(names: Column) -> Column:
    """The same for pages with the same markers."""
    return F.sha2(F.array_join(names, "|"), 256)

"""Population selection: declared constraints become predicates; what cannot be met fails before any work."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash52

# Presets of wear; the vocabulary of business types, those of the procedural catalogue, those that ship goods
# and those that were never on paper; capture conditions.
WEAR = {"crisp": (0.0, 0.25), "varied": (0.35, 1.0), "worn": (1.0, 1.0)}
BUSINESS_TYPES = ["retail", "wholesale", "auto_repair", "b2b_saas", "accounting", "ai_platform", "telecom", "legal", "consulting", "marketing_agency"]
KNOWN_TYPES = ["retail", "ecommerce", "grocery", "wholesale", "manufacturing", "pharmacy", "restaurant", "hospitality", "event_services", "auto_repair", "home_services", "construction", "equipment_rental", "facilities", "medical_clinic", "dental", "veterinary", "therapy", "legal", "accounting", "consulting", "marketing_agency", "staffing", "education", "b2b_saas", "ai_platform", "cloud_infra", "telecom", "utilities", "insurance", "lending", "wealth_management", "payments", "logistics", "freight", "fitness", "media_subscription"]
GOODS = ["retail", "ecommerce", "grocery", "wholesale", "manufacturing", "pharmacy"]
DIGITAL_NATIVE = ["b2b_saas", "ai_platform"]
HANDWRITTEN = "handwritten-form-01"
CONDITIONS = ["clean", "light_scan", "heavy_scan", "handwritten"]


class UnsupportedConstraint(ValueError):
    """A constraint that no population meets; names the values that are known."""


@dataclass(frozen=True)
class Selection:
    """What a run is restricted to; empty fields restrict nothing."""

    companies: tuple[str, ...] = ()
    locales: tuple[str, ...] = ()
    business_types: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    goods_receipts: bool = False
    wear: tuple[float, float] = (1.0, 1.0)
    dates: tuple[date, date] | None = None
    templates: int | tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, spec: dict) -> Selection:
        """From a mapping of scalars or lists; 'all' is no restriction."""
        many = lambda v: () if v in (None, "all") else (v,) if isinstance(v, str) else tuple(v)
        wear = spec.get("wear", "worn")
        span = WEAR.get(wear) if isinstance(wear, str) else (wear, wear) if isinstance(wear, int | float) else tuple(wear)
        if span is None or not 0 <= span[0] <= span[1] <= 1:
            raise UnsupportedConstraint(f"wear {wear!r}; known: {', '.join(WEAR)} or numbers from 0 to 1")
        days = spec.get("dates")
        if days is not None:
            first, last = (days["start"], days["end"]) if isinstance(days, dict) else days
            days = (date.fromisoformat(str(first)), date.fromisoformat(str(last)))
            if days[0] > days[1]:
                raise UnsupportedConstraint("dates run backwards")
        templates = spec.get("templates", ())
        out = cls(many(spec.get("companies")), many(spec.get("locales")), many(spec.get("business_types")), many(spec.get("conditions")), bool(spec.get("goods_receipts")), span, days, templates if isinstance(templates, int) else many(templates))
        for got, known, what in ((out.business_types, KNOWN_TYPES, "business type"), (out.conditions, CONDITIONS, "condition")):
            if bad := sorted(set(got) - set(known)):
                raise UnsupportedConstraint(f"unknown {what} {', '.join(bad)}; known: {', '.join(known)}")
        if out.goods_receipts and out.business_types and not set(out.business_types) & set(GOODS):
            raise UnsupportedConstraint(f"goods receipts need one of {', '.join(GOODS)}")
        pinned = sorted(t for t in out.templates if t != HANDWRITTEN) if isinstance(out.templates, tuple) else []
        if "handwritten" in out.conditions and pinned:
            raise UnsupportedConstraint(f"handwriting is always on {HANDWRITTEN}, never on {', '.join(pinned)}")
        return out

    def is_empty(self) -> bool:
        return self == Selection()

    def merged(self, other: Selection) -> Selection:
        """This selection with what the other one sets on top."""
        base = Selection()
        return replace(self, **{k: v for k, v in vars(other).items() if v != getattr(base, k)})

    def predicates(self) -> list[Column]:
        out = []
        if self.companies:
            out.append(F.col("company_id").isin(*self.companies))
        if self.locales:
            out.append(F.col("locale").isin(*self.locales))
        if self.business_types:
            out.append(F.col("business_type").isin(*self.business_types))
        if self.goods_receipts:
            out.append(F.col("business_type").isin(*GOODS))
        if "handwritten" in self.conditions:
            out.append(F.col("business_type") != "telecom")
        if set(self.conditions) - {"clean"}:
            out.append(~F.col("business_type").isin(*DIGITAL_NATIVE))
        return out

    def compose(self, companies: DataFrame, check: bool = True) -> DataFrame:
        """The companies that meet every constraint; none at all, or unknown ids, raise."""
        pool = companies
        for p in self.predicates():
            pool = pool.where(p)
        if check:
            if self.companies and (bad := [r.id for r in unknown_ids(companies, list(self.companies)).limit(20).collect()]):
                raise UnsupportedConstraint(f"unknown companies: {', '.join(bad)}")
            if pool.isEmpty():
                raise UnsupportedConstraint("no company meets all constraints together")
        return pool


def unknown_ids(companies: DataFrame, wanted: list[str], key: str = "company_id") -> DataFrame:
    """Asked-for ids that no company has."""
    asked = companies.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "id string")
    return asked.join(companies.select(F.col(key).alias("id")), "id", "left_anti")


def subset(rows: DataFrame, n: int, key: str, name: str = "subset", check: bool = False) -> DataFrame:
    """A reproducible sample of n rows without replacement, in the order of a hash."""
    if check and rows.count() < n:
        raise UnsupportedConstraint(f"{n} asked for, fewer there")
    return rows.withColumn("_draw", hash52(name, F.col(key))).orderBy("_draw", key).limit(n).drop("_draw")

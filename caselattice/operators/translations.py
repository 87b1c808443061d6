"""Translated views of item documents: texts may change, everything formal may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.functions.scalar import LABELS, cjk_count
from caselattice.operators.validation import violations

#: The formal fields of an item, of a constraint and of an entity, in the order in which they are checked.
FIELDS = ("family", "task", "scenario", "cl", "ds", "empirical_difficulty", "gold", "matrix", "signatures", "metadata")
OF_CONSTRAINT = ("constraint_id", "attribute", "required_value", "pos")
OF_ENTITY = ("name", "attributes", "display_order", "expected", "is_gold")


def _text(c: Column) -> Column:
    """A value as text: maps cannot be compared."""
    return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})


def _has_cjk(text: Column) -> Column:
    return F.coalesce(cjk_count(text) > 0, F.lit(False))


def in_chinese(items: DataFrame) -> DataFrame:
    """A stand-in for a translation: every text that is shown is marked, nothing formal is touched; `source_item_id` names the source."""
    marked = lambda t: F.concat(F.lit("中文："), t)
    return items.withColumns(
        {
            "question": marked(F.col("question")),
            "options": F.transform_values("options", lambda _, o: marked(o)),
            "constraints": F.transform("constraints", lambda c: c.withField("text", marked(c["text"]))),
            "source_item_id": F.col("item_id"),
        }
    )


def source_row() -> Column:
    """What a translation is compared with: the item's id and a digest (SHA-256 of the text) of each of its formal fields."""
    return F.struct("item_id", _formal().alias("formal"))


def translated_row() -> Column:
    """The same of a translated item, with the id of its source and whether each of its texts is translated."""
    told = [F.forall("constraints", lambda c: _has_cjk(c["text"])), *[_has_cjk(F.element_at("options", x)) for x in LABELS], _has_cjk(F.col("question"))]
    return F.struct("item_id", "source_item_id", _formal().alias("formal"), F.array(*told).alias("told"))


def translation_faults(sources: DataFrame, translated: DataFrame) -> DataFrame:
    """(item_id, rule_order, rule): each check that a translated item fails against its source, in their order: a source of that id,
    the formal fields, the constraints' fields and texts, the options' texts and the entities' fields, the question's text."""
    return faults(sources.select(source_row().alias("r")).select("r.*"), translated.select(translated_row().alias("r")).select("r.*"))


def faults(sources: DataFrame, translated: DataFrame) -> DataFrame:
    """translation_faults of rows of source_row and translated_row, so that digests meet and not documents."""
    pairs = translated.alias("t").join(sources.alias("s"), F.col("t.source_item_id") == F.col("s.item_id"), "left")
    # Where there is no source, its fields count as null.
    same = [F.get("t.formal", F.lit(i)) == F.coalesce(F.get("s.formal", F.lit(i)), _digest(F.lit(none))) for i, none in enumerate(_NULLS)]
    told = [F.get("t.told", F.lit(i)) for i in range(2 + len(LABELS))]
    n, m = len(FIELDS), len(FIELDS) + len(OF_CONSTRAINT)
    rules = [("source_item", F.col("s.item_id").isNotNull() & (F.col("t.item_id") == F.col("s.item_id")))]
    rules += zip(FIELDS, same[:n], strict=True)
    rules += zip([f"constraint_{f}" for f in OF_CONSTRAINT], same[n:m], strict=True)
    rules += zip(["constraint_text", *[f"option_{x}" for x in LABELS]], told[:-1], strict=True)
    rules += zip([f"entity_{f}" for f in OF_ENTITY], same[m:], strict=True)
    rules.append(("question", told[-1]))
    return violations(pairs.select(F.col("t.item_id").alias("item_id"), *[ok.alias(f"_{i}") for i, (_, ok) in enumerate(rules)]), [(name, F.col(f"_{i}")) for i, (name, _) in enumerate(rules)])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _formal() -> Column:
    """Digests of the fields, then of the constraints' and the entities' fields."""
    values = [*[F.col(f) for f in FIELDS], *[_each(F.col("constraints"), f) for f in OF_CONSTRAINT], *[_of_entities(F.col("entities"), f) for f in OF_ENTITY]]
    return F.array(*[_digest(_text(v)) for v in values])


#: The texts of null fields.
_NULLS = ['{"v":null}'] * (len(FIELDS) + len(OF_CONSTRAINT)) + [f'{{"v":[{",".join(["null"] * len(LABELS))}]}}'] * len(OF_ENTITY)


def _each(constraints: Column, name: str) -> Column:
    return F.transform(constraints, lambda c: c[name])


def _of_entities(entities: Column, name: str) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in LABELS]), lambda x: F.element_at(entities, x)[name])

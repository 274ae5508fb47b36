"""Small tables for the corpus tests."""

# Columns whose names the operators use inside.
CLASHING = "block string, payload string, n_words string, score string, row string, size string, copies string, band string, kept string"
N_CLASHING = CLASHING.count(",") + 1


def documents(spark, rows, source="src0"):
    """(doc_id, text) or (doc_id, text, source) rows, with extra columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, len(r[1] or ""), *["x"] * N_CLASHING) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def prose(rng, n, words=400):
    """n words from a vocabulary of the given size."""
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows(rng):
    """Nulls, empty texts, one very long text, ties and repeated rows."""
    long = prose(rng, 30_000, 5_000)
    same = prose(rng, 80)
    return [(None, same), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (5, same), (6, same + " end"), (None, None), (7, "z" * 5000), (8, "Ünï çödé"), (9, prose(rng, 60))]

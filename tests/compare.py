"""Results of a query and of its SQL, compared as sorted rows of text by column name."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(map(tuple, df[columns].astype(str).to_numpy().tolist())) + [tuple(columns)]

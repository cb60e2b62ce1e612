"""Declared schemas of the market tables and of the ledger's outputs."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "date": T.DateType(), "timestamp": T.TimestampType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])


CHAIN = _schema("ts timestamp,expiration date,strike double,option_type string,bid double,ask double,open_interest double,underlying_price double")
PRICES = _schema("date date,open double,high double,low double,close double,adjClose double")
DIVIDENDS = _schema("ex_date date,amount double")
RATES = _schema("date date,rate double")
EQUITY = _schema("session date,equity double,equity_liq double,cash double,reserved double,shares int,n_long int,n_short int")
TRADES = _schema(
    "pos_id int,kind string,open_session date,expiration date,strike double,option_type string,contracts int,open_price double,open_fee double,"
    "tag string,open_delta double,open_iv double,open_dte int,close_session date,close_price double,close_fee double,close_how string,pnl double"
)
EVENTS = _schema("session date,event string,amount double,shares int,strike double,contracts int")

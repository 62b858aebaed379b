from churnwise.sources.tables import OrderTables, load_order_tables, load_uploaded_csv  # noqa: F401
from churnwise.sources.testdata import load_purchase_events, load_test_tables, read_table  # noqa: F401

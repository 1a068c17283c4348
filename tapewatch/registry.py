"""Names of all queries and their SQL."""

from tapewatch.plans import amended, cases, forms, surveillance

QUERIES: dict = {**surveillance.QUERIES, **cases.QUERIES, **amended.QUERIES, **forms.QUERIES}
ORACLE: dict = {**surveillance.ORACLE, **cases.ORACLE, **amended.ORACLE, **forms.ORACLE}

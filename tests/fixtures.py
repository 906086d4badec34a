"""Small tables with known outcomes; ``row_id`` stands for the order of rows."""

TICKETS = (
    [(101, "Alex", "open"), (102, "Priya", "closed"), (103, "Alex", "open")],
    "ticket_id bigint, assigned_to string, status string",
)
DIRTY = (
    [(1, 2, "closed ", 20), (0, 1, " open", 10), (2, 2, "closed ", 20)],
    "row_id int, ticket_id bigint, status string, agent_id bigint",
)
INCIDENT_COUNTS = (
    [("Login", "P1", 5), ("Billing", "P2", 2), ("Login", "P1", 3), ("Operations", "P3", 1)],
    "Category string, Severity string, Count bigint",
)
RESOLVERS = (
    [("Alex", 12, "T1"), ("Priya", 5, "T2"), ("Alex", 18, "T3"), ("Sam", 7, "T4")],
    "Assigned_To string, Resolution_Time_Hours bigint, Ticket_ID string",
)
BALANCES = (
    [(1, "active", 150.0), (2, "inactive", 20.0), (3, "active", 500.0)],
    "user_id bigint, status string, balance double",
)
PEOPLE = (
    [("Alice Smith", "active"), ("Bob Jones", "active"), ("Carol Smith", "inactive")],
    "name string, status string",
)


def frame(spark, fixture):
    return spark.createDataFrame(*fixture)

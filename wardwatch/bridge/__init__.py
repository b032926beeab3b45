"""Views that present generic warehouse tables in the monitoring schemas.

They carry no clinical meaning; they let every operator run, and be checked
against SQL, on tables that grow.
"""

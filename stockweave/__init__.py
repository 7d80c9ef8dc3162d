"""Shared business data (masters, sales, inventory, planning) as Spark jobs."""

"""lodequarry: trace analytics and bulk text work expressed as Spark plans."""
